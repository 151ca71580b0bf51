"""The queries of this subpackage and, where it can express them, their SQL."""

from . import copies, defects, leaks, mixture, overlap, subjects, tokens

QUERIES = {
    "p1_found": defects.p1_found,
    "p1_report": defects.p1_report,
    "p2_found": copies.p2_found,
    "p2_collapsed": copies.p2_collapsed,
    "p3_found": leaks.p3_found,
    "p3_spans": leaks.p3_spans,
    "p4_found": overlap.p4_found,
    "p4_report": overlap.p4_report,
    "p5_ids": tokens.p5_ids,
    "p6_mix": mixture.p6_mix,
    "p6_shares": mixture.p6_shares,
    "p6_marginals": mixture.p6_marginals,
    "p7_found": subjects.p7_found,
    "p7_counts": subjects.p7_counts,
}
SQL = copies.SQL
