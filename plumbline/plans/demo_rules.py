"""Rules for the driver's tables, whose texts are ASCII: the published rules are for Japanese drawings."""

DICTIONARY = (
    ("supply pipe", "給水", "m", ("rod", "blue rod")),
    ("drain pipe", "排水", "m", ("ring",)),
    ("hot pipe", "給湯", "m", ("bolt",)),
    ("valve", "弁類", "個", ("gear", "hot gear")),
    ("basin", "衛生器具", "台", ("anvil",)),
    ("pump", "機器", "台", ("gizmo", "old gizmo")),
    ("duct", "ダクト", "m2", ("large plate",)),
)
#: unit price, unit, material share, spec, category, name, vendor
PRICES = (
    (3500.0, "m", 0.45, None, "給水", None, None),
    (3000.0, "m", 0.45, None, "排水", None, None),
    (4200.0, "m", 0.5, None, "給湯", None, None),
    (8000.0, "個", 0.6, None, "弁類", None, None),
    (60000.0, "台", 0.65, None, "衛生器具", None, None),
    (45000.0, "台", 0.65, None, "衛生器具", "basin", None),
    (180000.0, "台", 0.65, None, "機器", None, None),
    (9000.0, "m2", 0.5, None, "ダクト", None, None),
    (120000.5, "台", 0.65, "Brand#7 DN20", "機器", None, None),
    (7000.0, "個", 0.6, None, "弁類", None, "Brand#3"),
    (7100.0, "個", 0.6, None, "弁類", None, "Brand#3"),
    (2500.5, "m", 0.4, "Brand#5 DN13", None, None, None),
    (999.5, "m", 0.4, None, None, None, "Brand#9"),
)
LIVES = ((("brand#1", "supply"), 20, "A"), (("brand#2",), 25, "B"), (("gizmo", "pump"), 12, "C"))
PLANS = (("light", 12, 3000), ("standard", 6, 6000), ("premium", 3, 12000))
JOBS = (("tap", ("the", "ing", "tion"), 3000, 8000, 6), ("drain", ("von", "ung"), 8000, 18000, 1), ("boiler", ("eau", "que", "ment"), 80000, 250001, 24), ("leak", ("ci", "rr", "the"), 15000, 50000, 6), ("toilet", ("der", "die"), 8005, 20015, 1))
FALLBACK = ("visit", (), 5000, 15005, 0)
MUNICIPALITIES = (("NATION_1", ("NATION_2", "N3"), "form A", "office A"), ("NATION_15", ("xNATION_3x",), "form B", "office B"), ("", ("NATION_4",), "form C", "office C"))
DEFAULT_MUNICIPALITY = ("", (), "form", "office")
#: Entries with one finding of each kind.
FAULTY = (
    ("pipe", "給水", "m", ("tube", "hose", "hose")),
    ("", "給水", "m", ()),
    ("valve", "", "個", ("valve", "ab", "")),
    ("pump", "機器", "", ("tube", "pipe")),
    ("pump", "machines", "set", ("motor",)),
)
CURRENT_YEAR = 2015
