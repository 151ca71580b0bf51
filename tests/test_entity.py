from quern.functions import entity as E

PERSON = """{{Infobox person | name = Tom van der Berg | birth_date = {{Birth date and age|1950|3|2}} | death_date = (aged 60) 12 Mar. 2010
| birth_place = [[Loham|Loham town]], {{flag|Norland}} | occupation = {{hlist|painter|[[poet]]}}<ref>x</ref> <!-- no -->}}
[[File:x.jpg|thumb|a picture]]
'''Tom van der Berg''' (2 March 1950 - 12 March 2010) was a Norland painter and poet who lived near the sea for long."""


def test_person():
    kind, f, lead = E.extract("Tom van der Berg", PERSON)
    assert kind == "person" and f == {
        "birth_date": ("1950-03-02", "infobox"), "death_date": ("2010-03-12", "infobox"), "birth_place": ("Loham town, Norland", "infobox"), "occupation": ("painter, poet", "infobox"), "surname": ("van der Berg", "title"),
    }
    assert lead.startswith("Tom van der Berg (2 March 1950")
    kind, f, _ = E.extract("Ada", "'''Ada Lind Benner''' (born {{birth date|1815|12}}) is a retired sea captain from Loham, known to all of the town.")
    assert kind == "person" and f == {"birth_date": ("1815-12", "lead_text"), "occupation": ("retired sea captain", "lead_text"), "surname": ("Benner", "lead_bold")}
    assert E.life("Foo (c. 12 May 1900 or 1901) was a man") == {} and E.life("Foo (ruled 900 - 910)") == {} and E.life("Foo (900 to 910)") == {"birth_date": "0900", "death_date": "0910"}


def test_events_and_places():
    kind, f, _ = E.extract("Siege of Tem", "The '''siege''' was a long fight from 3 May 1701 to 5 June 1702 between two armies.")
    assert kind == "event" and f["date_range"] == ("1701-05-03/1702-06-05", "lead_text")
    kind, f, _ = E.extract("Great storm", "{{Infobox storm|formed=May 3, 1901|dissipated=May 9, 1901|areas=x|affected=Coast: [[Norland]]}}\nThe storm was strong and it came from the west over the sea.")
    assert kind == "event" and f == {"date_range": ("1901-05-03/1901-05-09", "infobox"), "location": ("Norland", "infobox")}
    kind, f, _ = E.extract("Old war", "{{Infobox military conflict|date=490-480 BC}}\nThe old war was fought for long years by the towns of the coast.")
    assert kind == "event" and f["date_range"] == ("-0490/-0480", "infobox")
    kind, f, _ = E.extract("Velga", "'''Velga''' is a small market town in the Tem Valley, Norland and has an old bridge over the river.")
    assert kind == "place" and f == {"location": ("Tem Valley, Norland", "lead_text")}
    kind, f, _ = E.extract("Norland", "{{Infobox country|capital=[[Velga]]|population_estimate=about 1,234,567 (2020)|region=North}}\n'''Norland''' is a country in the far north of the continent, cold.")
    assert kind == "country" and f == {"capital": ("Velga", "infobox"), "quantity": ("1234567", "infobox")}
    kind, f, _ = E.extract("Tem", "{{Infobox river|country=Norland|state=East|province=West|pop=12}}\nThe '''Tem''' is a river that runs through the valley to the cold sea.")
    assert kind == "place" and f == {"location": ("Norland, East", "infobox")}
    assert E.extract("Word", "A word is something that one can say, write or read, and that means a thing.")[:2] == ("other", {})


def test_reverse_capitals_and_odd_markup():
    assert E.capital_of("Velga is the capital city of the Norland Isles, and its largest town") == ("Norland Isles", "Velga") and E.capital_of("The Velga was the capital of Norland.") == ("Norland", "Velga") and E.capital_of("It is a capital of Foo") is None
    for text in ("", "{{", "}}", "[[a|b", "{{Infobox person|birth_date={{Birth date|19", "{{a|{{b|}}", "|=|", "x" * 50_000, "{{" * 500, "'''"):
        E.extract("T", text)
    assert E.extract("T", "{{Infobox person|birth_date=1 May 1900")[1]["birth_date"] == ("1900-05-01", "infobox")
    assert E.clean(E.tree("a<br>b* c {{USA}} [http://x y z] &amp; <i>é</i>")) == "a, b* c United States y z & e"
    assert E.family_name("Ada Benner Jr.") == "Benner" and E.family_name("Ada of Loham") is None and E.family_name("Ada IV") is None and E.family_name("Ada") is None
    assert E.count(["12 (2001: 9,999) 1,234,567"]) == "1234567" and E.count(["12.5"]) is None
