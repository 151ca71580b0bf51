"""Wiki pages to typed entities: the markup as a tree, values by a table of rules, leads read word by word.

Dates are YYYY, YYYY-MM or YYYY-MM-DD, - before years BC; a range is two of them with / between. Values are ASCII.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import functions as F

from quern.functions import dates, wiki

# ---- the markup as a tree


@dataclass
class Node:
    """A template or a link: its arguments, each a list of texts and nodes."""

    kind: str
    args: list[list] = field(default_factory=lambda: [[]])

    @cached_property
    def name(self) -> str:
        return " ".join(shown(self.args[0]).replace("_", " ").split()).lower()


_NOTE = re.compile(r"<!--.*?(?:-->|$)|<ref[^>/]*/>|<ref\b[^>]*>.*?</ref>", re.S | re.I)
_MARK = re.compile(r"(\{\{|\}\}|\[\[|\]\]|\|)")
#: Marks nested deeper are text.
DEEPEST = 60
_CLOSED_BY = {"{{": "}}", "[[": "]]"}


def tree(text: str) -> list:
    """Texts and nodes of a page, comments and references left out. What is never closed goes to the end."""
    stack = [Node("page")]
    for piece in _MARK.split(_NOTE.sub("", text)):
        top = stack[-1]
        if piece in _CLOSED_BY and len(stack) < DEEPEST:
            stack.append(Node(piece))
        elif piece == "|" and top.kind != "page":
            top.args.append([])
        elif piece in _CLOSED_BY.values() and piece == _CLOSED_BY.get(top.kind):
            stack.pop()
            stack[-1].args[-1].append(top)
        elif piece:
            top.args[-1].append(piece)
    while len(stack) > 1:
        top = stack.pop()
        stack[-1].args[-1].append(top)
    return stack[0].args[0]


# D3. The templates that give one date; two dates; a date behind three other numbers.
_ONE_DATE = frozenset(
    "birth date|birth-date|birth date and age|death date|death date and age|start date|start date and age|end date|dob|end date and age|film date|date|bda|dda|birth year and age|death year and age|birth year|death year|birth based on age as of date".split("|")
)
_TWO_DATES, _LATER_DATE = frozenset(("start and end dates", "start-end dates")), "birth date and age2"
# Templates that list their arguments; templates and codes of flags.
_LISTS = frozenset("hlist|flatlist|plainlist|unbulleted list|ubl|bulleted list|nowrap|nobold|small|smaller|plain list|collapsible list".split("|"))
_FLAGS = frozenset(("flag", "flagcountry"))
_CODES = {
    code: name
    for codes, name in (
        x.split(":")
        for x in "USA:United States|GBR UK:United Kingdom|FRA:France|GER DEU:Germany|ITA:Italy|ESP:Spain|POR PRT:Portugal|NED NLD:Netherlands|BEL:Belgium|SUI CHE:Switzerland|AUT:Austria|SWE:Sweden|NOR:Norway|DEN DNK:Denmark|FIN:Finland|POL:Poland|CZE:Czech Republic|HUN:Hungary|ROU ROM:Romania|BUL BGR:Bulgaria|GRE GRC:Greece|TUR:Turkey|RUS:Russia|UKR:Ukraine|BLR:Belarus|CHN:China|JPN:Japan|KOR:South Korea|PRK:North Korea|IND:India|PAK:Pakistan|BAN BGD:Bangladesh|IDN INA:Indonesia|PHI PHL:Philippines|VNM VIE:Vietnam|THA:Thailand|MAS MYS:Malaysia|SIN SGP:Singapore|AUS:Australia|NZL:New Zealand|CAN:Canada|MEX:Mexico|BRA:Brazil|ARG:Argentina|CHI CHL:Chile|COL:Colombia|PER:Peru|VEN:Venezuela|EGY:Egypt|RSA ZAF:South Africa|NGA:Nigeria|KEN:Kenya|ETH:Ethiopia|MAR:Morocco|ALG DZA:Algeria|IRN:Iran|IRQ:Iraq|ISR:Israel|SAU KSA:Saudi Arabia|AFG:Afghanistan|IRL:Ireland|SCO:Scotland|ENG:England|WAL:Wales|CRO HRV:Croatia|SRB:Serbia|SVK:Slovakia|SVN:Slovenia|LTU:Lithuania|LVA:Latvia|EST:Estonia|ISL:Iceland|CUB:Cuba|JAM:Jamaica".split("|")
    )
    for code in codes.split()
}


def _template_dates(node: Node) -> list[str]:
    numbers = [x for x in (shown(a).strip() for a in node.args[1:]) if re.fullmatch(r"-?\d{1,4}", x)]
    if node.name == _LATER_DATE:
        numbers = numbers[3:]
    out = []
    for k in range(2 if node.name in _TWO_DATES else 1):
        y, *rest = numbers[3 * k : 3 * k + 3] or ["0"]
        if all(x.isdigit() for x in rest):
            out.append(dates.iso(abs(int(y)), *map(int, rest), bc=y.startswith("-")))
    return [d for d in out if d]


def shown(parts: list) -> str:
    """What a reader sees of texts and nodes; dates of templates between dates.ON and dates.OFF, other templates not at all."""
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(p)
        elif p.kind == "[[":
            target = shown(p.args[0])
            out.append("" if re.match(r"(?i)(?:file|image|category):", target) else shown(p.args[-1]))
        elif p.name in _ONE_DATE or p.name in _TWO_DATES or p.name == _LATER_DATE:
            out.append(" ".join(dates.ON + d + dates.OFF for d in _template_dates(p)))
        elif p.name in _LISTS:
            out.append(", ".join(shown(a) for a in p.args[1:]))
        elif p.name in _FLAGS and len(p.args) > 1:
            out.append(shown(p.args[1]))
        else:
            out.append(_CODES.get(p.name.upper(), "") if len(p.args) == 1 else "")
    return "".join(out)


_TYPOGRAPHIC = str.maketrans({"–": "-", "—": "-", "−": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...", "\xa0": " ", "×": "x"})


def ascii_only(s: str) -> str:
    return unicodedata.normalize("NFKD", s.translate(_TYPOGRAPHIC)).encode("ascii", "ignore").decode()


def clean(parts: list | str) -> str:
    """one line of plain ASCII; line breaks and list items are commas; dates of templates stay marked."""
    s = parts if isinstance(parts, str) else shown(parts)
    s = re.sub(r"\[(?:https?:)?//[^\s\]]+\s*([^\]]*)\]", r"\1", s)
    s = re.sub(r"(?i)<br\s*/?>|</?li>|(?:^|\n)[ \t]*[*#]+", ", ", s)
    s = ascii_only(html.unescape(re.sub(r"<[^>]*>|'{2,}", "", s)))
    return re.sub(r"\s*,(?:\s*,)+\s*|\s+,\s*", ", ", " ".join(s.split())).strip(" ,;")


def _unmarked(s: str) -> str:
    return s.replace(dates.ON, "").replace(dates.OFF, "")


# ---- the infobox and what its parameters say


def infobox_of(page: list) -> tuple[str, dict[str, list]]:
    """the first infobox's name without that word, and its parameters, the first of each name."""
    box = next((p for p in page if isinstance(p, Node) and p.kind == "{{" and p.name.startswith("infobox")), None)
    out: dict[str, list] = {}
    for arg in box.args[1:] if box else ():
        if arg and isinstance(arg[0], str) and "=" in arg[0]:
            key, _, rest = arg[0].partition("=")
            key, value = "_".join(key.lower().replace("_", " ").split()), [rest.lstrip(), *arg[1:]]
            if key and shown(value).strip():
                out.setdefault(key, value)
    return box.name.removeprefix("infobox").strip() if box else "", out


def _dates_of(value: list) -> list[str]:
    """Dates outside parentheses; an era that stands anywhere holds for all of them."""
    s = re.sub(r"\([^()]*\)", " ", clean(value))
    era = bool(re.search(r"\bBCE?\b", s)) and not re.search(r"\b(?:AD|CE)\b", s)
    return [d if not era or d.startswith("-") else f"-{d}" for d in dates.scan(s)]


def point(value: list) -> str | None:
    return next(iter(_dates_of(value)), None)


def span(value: list) -> str | None:
    return "/".join(dict.fromkeys(_dates_of(value)[:2])) or None


def words_of(limit: int) -> Callable[[list], str | None]:
    """A text cut at a comma or a blank."""

    def read(value: list) -> str | None:
        s = _unmarked(clean(value))
        if len(s) > limit:
            head = s[: limit + 1]
            s = (head[: head.rfind(",")] if "," in head else head.rsplit(" ", 1)[0])[:limit].rstrip(" ,;")
        return s or None

    return read


def count(value: list) -> str | None:
    """The first number of three digits or more; groups of three may be parted by commas."""
    for n in re.findall(r"[\d.,]*\d", re.sub(r"\([^()]*\)", " ", clean(value))):
        if re.fullmatch(r"\d{1,3}(?:,\d{3})+|\d{3,}", n):
            return n.replace(",", "")
    return None


# Of each kind, its relations with the parameters that may hold them, the first that is there, and how they are read.
_PLACE = "subdivision_name subdivision_name1 country state region location department canton district_name province"
RULES: dict[str, list[tuple[str, str, Callable]]] = {
    "person": [("birth_date", "birth_date born", point), ("death_date", "death_date died", point), ("birth_place", "birth_place", words_of(60)), ("death_place", "death_place", words_of(60)), ("occupation", "occupation profession", words_of(60))],
    "event": [("date_range", "date dates start_date formed began start year duration time dated", span), ("location", "place location venue site areas_affected affected area", words_of(60))],
    "place": [("capital", "capital", words_of(40)), ("quantity", "population_total population population_estimate pop population_census", count)],
}
RULES["country"] = RULES["place"]
_NO_CAPITAL, _ENDS = ("none", "n/a", "yes"), "end_date dissipated ended end".split()


def box_fields(kind: str, prm: dict[str, list]) -> dict[str, str]:
    out = {}
    for rel, names, read in RULES.get(kind, ()):
        for n in names.split():
            if n in prm:
                value = prm[n]
                if rel == "date_range" and n not in ("date", "dates"):  # a beginning may have its end elsewhere
                    value = [*value, " ", *next((prm[e] for e in _ENDS if e in prm), [])]
                if got := read(value):
                    out[rel] = got
                if rel not in ("birth_date", "death_date") or got:
                    break
    if kind == "event" and "location" in out:
        out["location"] = out["location"].split(":", 1)[-1].strip(" ,") if re.match(r"[A-Za-z ]{3,25}:", out["location"]) else out["location"]
    if out.get("capital", "").lower() in _NO_CAPITAL:
        out.pop("capital", None)
    if kind in ("place", "country") and "capital" not in prm:
        near = dict.fromkeys(v for n in _PLACE.split() if n in prm and (v := words_of(40)(prm[n])) and len(v) > 1 and not v.lower().startswith("http"))
        if near:
            out["location"] = ", ".join(list(near)[:2])[:60]
    return out


# ---- D5: what the lead says


def lead_of(page: list) -> str:
    """The first paragraph of prose, templates but for dates left out."""
    for line in shown(page).split("\n"):
        line = line.strip()
        if line and line[0] not in "=*#:;|!{" and not line.startswith("__") and len(s := clean(line)) > 30:
            return s
    return ""


# Words that end a description; kinds of places; prepositions before a place's name; what goes on behind it.
_STOPS = frozenset("who that from in of born known which at for with on".split())
_KINDS = frozenset("city town village commune municipality county state province region district river mountain island lake country capital department canton suburb neighbourhood park volcano desert peninsula archipelago sea bay area prefecture borough".split())
_NEAR = frozenset("in on of within near at".split())
_COPULA = frozenset("is was are were".split())
_ARTICLE = frozenset("a an the".split())


def _tokens(s: str) -> list[str]:
    return re.findall(r"[A-Za-z][\w'-]*|[^\w\s]|\d+", s)


def _described(lead: str) -> list[str]:
    """The words behind the first is or was with an article, within the first sentences."""
    t = _tokens(lead[:300])
    at = next((i for i, w in enumerate(t[:-1]) if w in _COPULA and t[i + 1].lower() in _ARTICLE), None)
    return t[at + 2 :] if at is not None else []


def occupation(lead: str) -> str | None:
    out = []
    for w in _described(lead):
        if w in _STOPS or not re.match(r"[A-Za-z]", w) or w == "and" and len(out) > 4:
            break
        out.append(w.lower())
    while out and out[-1] == "and":
        out.pop()
    return " ".join(out) if 1 <= len(out) <= 5 else None


def _name_at(t: list[str], i: int) -> str | None:
    """Capitalised words from there on, and those behind one comma."""
    if t[i : i + 1] == ["the"]:
        i += 1
    out: list[str] = []
    while i < len(t) and (t[i][0].isupper() or t[i] == "," and out and "," not in out and t[i + 1 : i + 2] and t[i + 1][0].isupper()):
        out.append(t[i])
        i += 1
    return " ".join(out).replace(" ,", ",") or None


def lies_in(lead: str) -> str | None:
    t = _described(lead)
    kind = next((i for i, w in enumerate(t[:7]) if w.lower() in _KINDS), None)
    if kind is None:
        return None
    return next((name for i in range(kind + 1, min(kind + 4, len(t))) if t[i] in _NEAR and (name := _name_at(t, i + 1))), None)


def capital_of(lead: str) -> tuple[str, str] | None:
    """(country, capital) of a lead that begins with: X is the capital of Y."""
    head, sep, tail = lead[:200].partition(" the capital ")
    ws, t = head.removeprefix("The ").split(), _tokens(tail)
    if not sep or len(ws) < 2 or ws[-1] not in ("is", "was"):
        return None
    t = t[1:] if t[:1] == ["city"] else t
    country = _name_at(t, 1) if t[:1] == ["of"] else None
    return (country.split(",")[0], " ".join(ws[:-1])) if country else None


def life(lead: str) -> dict[str, str]:
    """Birth and death of the first parenthesis: born and a date, or two dates with a dash or to between."""
    inner = lead.partition("(")[2].partition(")")[0] if "(" in lead[:101] else ""
    ds = dates.found(inner)
    if not ds or re.search(r"(?i)\b(?:ca|circa|or|reigned|ruled)\b|/|\br\.", inner):
        return {}
    if re.match(r"(?i)\s*(?:born|b\.)\s", inner):
        return {"birth_date": ds[0][0]}
    if len(ds) > 1 and inner[ds[0][2] : ds[1][1]].strip(" ,.") in ("-", "to", "until"):
        return {"birth_date": ds[0][0], "death_date": ds[1][0]}
    return {}


def happened(lead: str) -> str | None:
    """When: two dates with a word between, or the first one behind in or on."""
    ds = dates.found(lead[:300])
    for (a, _, end), (b, begin, _) in zip(ds, ds[1:]):
        if lead[end:begin].strip() in ("to", "until", "and", "-"):
            return a if a == b else f"{a}/{b}"
    return next((d for d, begin, _ in ds if re.search(r"(?i)\b(?:in|on)\s*$", lead[:begin]) or lead[begin] == dates.ON), None)


# What stands before and behind a family name.
_BEFORE = frozenset("van von de der den di da del della du la le bin ibn al el ter ten dos das y mac".split())
_BEHIND = frozenset("jr sr ii iii iv".split())


def family_name(name: str) -> str | None:
    ws = [w for w in name.replace(",", " ").split() if w.lower().rstrip(".") not in _BEHIND]
    if len(ws) < 2 or "of" in ws or any(re.fullmatch("[IVXLC]{1,4}", w) for w in ws[1:]):
        return None
    first = len(ws) - 1
    while first > 1 and ws[first - 1].lower() in _BEFORE:
        first -= 1
    return " ".join(ws[first:])


def surname(title: str, prm: dict[str, list], text: str) -> tuple[str, str] | None:
    """of the title, or if that is a single name, of a fuller one that has it: the infobox's or the lead's bold one."""
    base = ascii_only(re.sub(r"\s*\([^()]*\)$", "", title)).strip()
    if own := family_name(base):
        return own, "title"
    given = base.lower().split()[:1]
    bold = re.search(r"'''(.{2,60}?)'''", text)
    fuller = {"infobox": clean(prm.get("full_name") or prm.get("birth_name") or []), "lead_bold": clean(tree(bold[1])) if bold else ""}
    for source, name in fuller.items():
        if given and given[0] in name.lower().split() and (own := family_name(name)) and own.lower() != given[0]:
            return own, source
    return None


# ---- R13: the kind of entity. Words of infobox names and titles.
_EVENTS = frozenset(
    "conflict war battle event earthquake disaster election treaty protest massacre siege attack rebellion revolution accident storm hurricane olympics tournament festival crime incident operation tropical flood eruption coup strike riot referendum expedition summit concert competition race season launch mission".split()
)
_EVENT_TITLE = frozenset("war battle siege revolution treaty massacre rebellion earthquake eruption".split())
_PLACES = frozenset(
    "settlement city town commune comune location county district village municipality river mountain island lake place state province region park building bridge airport station castle volcano valley desert canal dam peninsula sea ocean forest university school stadium museum church road".split()
)
_STATES = frozenset("country sovereign nation republic kingdom".split())


def kind_of(title: str, box: str, prm: dict[str, list], lead: str) -> str:
    """Person, event, country, place or other: by the infobox's parameters and name, without one by title and lead."""
    named = frozenset(re.findall("[a-z]+", box))
    if prm.keys() & {"birth_date", "born", "death_date"} and "conflict" not in prm or not box and life(lead) and not frozenset(title.lower().split()) & _EVENT_TITLE:
        return "person"
    if box and named & _EVENTS and not named <= _PLACES or not box and frozenset(title.lower().split()) & _EVENT_TITLE:
        return "event"
    if "capital" in prm or named & _STATES:
        return "country"
    return "place" if named & _PLACES or not box and lies_in(lead) else "other"


def extract(title: str, text: str) -> tuple[str, dict[str, tuple[str, str]], str]:
    """(kind, {relation: (value, provenance)}, lead)."""
    page = tree(text)
    (box, prm), lead = infobox_of(page), lead_of(page)
    kind = kind_of(title, box, prm, lead)
    said: dict[str, str | None] = {}
    if kind == "person":
        said = life(lead) | {"occupation": occupation(lead)}
    elif kind == "event":
        said = {"date_range": happened(lead)}
    elif kind == "place":
        said = {"location": lies_in(lead)}
    out = {rel: (v, "lead_text") for rel, v in said.items() if v} | {rel: (v, "infobox") for rel, v in box_fields(kind, prm).items()}
    if kind == "person" and (s := surname(title, prm, text)):
        out["surname"] = s
    return kind, out, lead


KIND = "struct<etype: string, typed: map<string, struct<value: string, prov: string>>, capital_of: string, capital: string>"


def extract_udf(*cols):
    def run(titles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for title, text in zip(titles, texts):
            kind, fields, lead = extract(title, text)
            of, capital = (capital_of(lead) if kind in ("place", "other") else None) or (None, None)
            rows.append((kind, {k: {"value": v, "prov": p} for k, (v, p) in fields.items()}, None if of is None else wiki.fold(of), capital))
        return pd.DataFrame(rows, columns=["etype", "typed", "capital_of", "capital"])

    return F.pandas_udf(run, KIND)(*cols)
