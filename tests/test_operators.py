"""Operators on small inputs with known results."""

import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline import rules, schema
from plumbline.functions import scalar
from plumbline.operators import accuracy, advice, extract, geometry, items, ledger, pricing, produce, reconcile, validate
from plumbline.operators import classify as dictionary
from plumbline.plans import flows, reports
from plumbline.sources import files, rule_files, sinks

# The 22 sample rows that the golden figures belong to.
SAMPLE = [
    ("給水管(SGP)", "VLP DN20", 28.5, "m", "1F 給水系統", 0.8), ("給水管(HIVP)", "HIVP DN13", 15.0, "m", "1F 給水系統", 0.8), ("給湯管(被覆銅管)", "CUP DN15", 22.0, "m", "1F 給湯系統", 0.75),
    ("排水管(VP)", "VP DN50", 18.0, "m", "1F 排水系統", 0.8), ("通気管(VP)", "VP DN40", 9.0, "m", "1F 通気系統", 0.7), ("仕切弁", "GV DN20", 4.0, "個", "1F PS", 0.9),
    ("90°エルボ", "DN20", 12.0, "個", "1F 給水系統", 0.6), ("大便器(洋式)", "TOTO CS232B", 2.0, "台", "1F 便所", 0.9), ("洗面器", "LIXIL L-2151", 2.0, "台", "1F 便所", 0.9),
    ("壁掛ガス給湯器", "RUF-24A", 1.0, "台", "1F 屋外", 0.85), ("配管保温(GW20mm)", "給水管 GW20mm", 28.5, "m", "1F 給水系統", 0.7), ("冷媒管(ペアコイル)", "2分3分", 16.0, "m", "1F 空調", 0.75),
    ("断熱材(グラスウール)", "高性能GW16K t90", 120.0, "m2", "外壁", 0.8), ("押出法ポリスチレンフォーム", "XPS t50", 65.0, "m2", "1F 床", 0.8), ("硬質ウレタンフォーム", "吹付 t30", 80.0, "m2", "屋根", 0.75),
    ("防湿気密シート", "0.2mm", 120.0, "m2", "外壁", 0.7), ("保温筒", "GW20mm", 28.5, "m", "1F 給水系統", 0.75), ("ラッキング", "アルミ0.3mm", 18.0, "m2", "屋外配管", 0.7),
    ("冷温水配管", "鋼管 80A", 45.0, "m", "1F 空調 氷蓄熱系統", 0.8), ("圧力計", "0〜0.6MPa", 6.0, "個", "1F 機械室", 0.85), ("電動弁", "MV 80A", 4.0, "個", "1F 空調 氷蓄熱系統", 0.8),
    ("全熱交換器", "HEX-1 250型", 2.0, "台", "1F 各室", 0.85),
]
ENTRIES = [
    ("給水管", "給水", "m", []), ("給湯管", "給湯", "m", []), ("排水管", "排水", "m", []), ("通気管", "通気", "m", []), ("冷媒管", "冷媒", "m", ["ペアコイル"]), ("仕切弁", "弁類", "個", []), ("継手", "継手", "個", ["エルボ"]),
    ("大便器", "衛生器具", "台", []), ("洗面器", "衛生器具", "台", []), ("給湯器", "機器", "台", ["壁掛給湯器"]), ("保温", "保温", "m", ["配管保温"]), ("保温筒", "保温", "m", []), ("ラッキング", "保温", "m2", []),
    ("断熱材(グラスウール)", "断熱材", "m2", []), ("押出法ポリスチレンフォーム", "断熱材", "m2", []), ("硬質ウレタンフォーム", "断熱材", "m2", []), ("防湿気密シート", "気密防湿", "m2", []), ("冷温水配管", "冷温水", "m", []),
    ("圧力計", "計装", "個", []), ("電動弁", "弁類", "個", []), ("全熱交換器", "機器", "台", []),
]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame([(i, *e) for i, e in enumerate(ENTRIES)], schema.DICTIONARY)


@pytest.fixture(scope="module")
def sample(spark, entries):
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(SAMPLE)], "ord long, name string, spec string, quantity double, unit string, location string, confidence double")
    return dictionary.classify(raw, entries).cache()


def test_golden_estimate(spark, sample):
    lines = flows.estimate(sample, rules.prices(spark))
    t = pricing.totals(lines).first()
    assert (t["n_lines"], t["subtotal"], t["overhead"], t["tax"], t["total"]) == (22, 2_506_800, 250_680, 275_748, 3_033_228)
    assert (t["material"], t["labor"]) == (1_427_728, 1_079_073)
    first = lines.filter("ord = 0").first()
    assert (first["amount"], first["material"], first["labor"]) == (99_750, 44_888, 54_863)
    book = sinks.estimate_book(lines.withColumn("p", F.lit(1)), ["p"], "ord")
    assert [r["amount"] for r in book["summary"].orderBy("pos").collect()] == [2_506_800, 250_680, 275_748, 3_033_228]


def test_golden_maintenance(spark, sample):
    rows = ledger.ledger(sample, rules.lives(spark), F.lit(2008), 2026)
    assert rows.count() == 13
    due = {(r["name"], r["remaining"], r["state"]) for r in ledger.due(rows).collect()}
    assert due == {("給湯器", -6, "★更新時期"), ("冷媒管", -3, "★更新時期")}
    plan = ledger.recommend_plan(rows.withColumn("p", F.lit(1)), rules.plans(spark), ["p"]).first()["plan"]
    assert plan == "プレミアムプラン"
    text = reports.maintenance(rows, rules.plans(spark), plan, 2008, 2026)
    assert "プレミアムプラン" in text and "¥144,000" in text


def test_golden_pipes_and_fixtures(spark, sample):
    supply, drainage, fixtures = flows.application(sample)
    assert [tuple(r) for r in supply.orderBy("system", "caliber").collect()] == [("給水", "DN13", 15.0, "HIVP"), ("給水", "DN20", 28.5, "VLP"), ("給湯", "DN15", 22.0, "CUP")]
    assert {tuple(r) for r in fixtures.collect()} == {("大便器", 2.0), ("洗面器", 2.0)}
    form = advice.resolve_authority(spark.createDataFrame([("千葉広域水道企業団",)], "m string"), rules.municipalities(spark), "m").first()
    assert "千葉県企業局" in form["authority"]
    project = dict.fromkeys(rule_files.PROJECT_KEYS, "")
    text = reports.application(project, {**form.asDict(), "documents": ["図"]}, supply, drainage, fixtures)
    assert "DN20" in text and "65.5 m" in text and "- [ ] 図" in text


def test_partial_match_goes_by_order_and_length(spark, sample, entries):
    got = {r["ord"]: (r["name"], r["category"], r["matched"]) for r in sample.collect()}
    assert got[6] == ("継手", "継手", "partial") and got[10] == ("保温", "保温", "partial") and got[5][2] == "exact"
    odd = spark.createDataFrame([("継手部品", ""), ("ラッキング", ""), ("ﾗｯｷﾝｸﾞ", "m"), ("謎", "式")], "name string, unit string")
    want = [("継手部品", "その他", ""), ("ラッキング", "保温", "m2"), ("ラッキング", "保温", "m"), ("謎", "その他", "式")]
    assert [(r["name"], r["category"], r["unit"]) for r in dictionary.classify(odd, entries).collect()] == want


def test_large_dictionary_takes_the_join(spark, sample, entries, monkeypatch):
    monkeypatch.setattr(dictionary, "MAX_INLINE", 3)
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(SAMPLE)], "ord long, name string, spec string, quantity double, unit string, location string, confidence double")
    columns = ["ord", "name", "category", "unit", "matched"]
    assert sorted(map(tuple, dictionary.classify(raw, entries).select(*columns).collect())) == sorted(map(tuple, sample.select(*columns).collect()))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(*[st.sampled_from([None, "a", "b"])] * 4), min_size=1, max_size=8))
def test_price_rule_against_a_plain_scan(spark, keys):
    table = spark.createDataFrame([(i, float(i + 1), "m", 0.5, *k, "") for i, k in enumerate(keys)], schema.PRICE)
    asked = [(s, c, n, v) for s in ("a", "b", None) for c in ("a", None) for n in ("a", "b") for v in ("a", None)]
    df = spark.createDataFrame([(*a, 1.0, "m") for a in asked], "spec string, category string, name string, vendor string, quantity double, unit string")
    got = {(r["spec"], r["category"], r["name"], r["vendor"]): r["price"] and r["price"]["unit_price"] for r in pricing.quote(df, table, F.col("vendor")).collect()}
    for a in asked:
        best = max((( (k[3] is not None) * 8 + (k[0] is not None) * 4 + (k[1] is not None) * 2 + (k[2] is not None), -i) for i, k in enumerate(keys) if all(x is None or x == y for x, y in zip(k, a, strict=True))), default=None)
        assert got[a] == (None if best is None else float(1 - best[1]))


def test_rounding_halves_to_even(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.5, 2.4999, -0.5, -1.5)], "x double")
    assert [r[0] for r in df.select(scalar.yen(F.col("x"))).collect()] == [round(x) for x in (0.5, 1.5, 2.5, 2.4999, -0.5, -1.5)]


def test_scalars(spark):
    df = spark.createDataFrame([("VLP DN20", 0), ("  SGP 25 mm", 1), ("80A", 2), ("GV８０Ａ", 3), (None, 4), ("  ", 5), ("DN1000", 6), ("ｘ 50ａ", 7)], "s string, i int")
    got = df.orderBy("i").select(scalar.caliber(F.col("s")), scalar.pipe_material(F.col("s")), scalar.norm(F.col("s"))).collect()
    assert [r[0] for r in got] == ["DN20", "DN25", "DN80", "口径不明", "口径不明", "口径不明", "DN100", "口径不明"]
    assert [r[1] for r in got] == ["VLP", "SGP", "", "GV８０Ａ", "", "", "", "ｘ"]
    assert got[3][2] == "gv80a" and got[4][2] == "" and got[7][2] == "x50a"
    one = df.limit(1).select(scalar.number_text(F.lit(12.0)), scalar.number_text(F.lit(28.5)), scalar.yen_text(F.lit(1234567)), scalar.first_number(F.lit(None), F.lit(""), F.lit(" ２.5 ")), scalar.first_number(F.lit("x"), F.lit("1")))
    assert tuple(one.first()) == ("12", "28.5", "¥1,234,567", 2.5, None)
    pairs = [("gvdn20", "dn20", True), ("ab", "abc", False), ("", "", False), ("x", "x", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.filter(scalar.spec_match(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_text_lines(spark):
    text = "給湯器 RUF-24A 2台\n仕切弁 GV 80A 5個\n備考だけ\n保温(GW) t20 28.5m\r\n2台\nダクト 12 m²\nx 3mm"
    got = extract.table_lines(spark.createDataFrame([(1, text), (2, None)], "page int, text string"), "text", ["page"]).orderBy("line_no").collect()
    assert [(r["name"], r["spec"], r["quantity"], r["unit"]) for r in got] == [("給湯器 RUF-24A", "RUF-24A", 2.0, "台"), ("仕切弁 GV 80A", "80A", 5.0, "個"), ("保温(GW) t20", "t20", 28.5, "m"), ("ダクト", None, 12.0, "m2")]


def test_legend(spark):
    text = "SA 吹出口\nEA：吸込口\nFCU ファンコイル\nVAV 変風量\nDN20 配管\nTHE 図\nSA 別名\nSA-1 SA-2 SA3 EA EA-9 XEA FCU-1 FCU-2 FCU-3 FCU4"
    pages = spark.createDataFrame([(1, text)], "page int, text string")
    assert {r["code"]: r["name"] for r in extract.legend_entries(pages, "text", ["page"]).collect()} == {"SA": "吹出口", "EA": "吸込口", "FCU": "ファンコイル", "VAV": "変風量"}
    assert {r["spec"]: r["quantity"] for r in extract.legend_items(pages, "text", ["page"]).collect()} == {"SA": 4.0, "EA": 2.0, "FCU": 4.0}
    one = pages.select(extract.symbol_codes(F.lit("EI2-GR06 GR01 THE P02 FCU-2 LA04 GR01 a1 X")))
    assert one.first()[0] == ["EI2-GR06", "GR01", "LA04", "P02"]


def test_json_replies(spark):
    rows = [
        (1, '```json\n[{"name": "a", "quantity": "2", "confidence": 0, "bbox": [1, 2, 3, 4]}]\n```'),
        (2, '[{"name": "a", "unit": "m"}, 3, "x", {"name": "b", "unit": null}, {"page": 0, "name": "c"}, {"page": "2", "name": "d", "quantity": ""}, {"quantity": "many"}]'),
        (3, '[{"name": "a"'), (4, '{"name": "a"}'), (5, None), (6, "[]"),
    ]
    got = extract.json_items(spark.createDataFrame(rows, "id int, raw string"), "raw", ["id"], F.lit(7)).orderBy("id", "pos").collect()
    assert [(r["id"], r["pos"], r["page"], r["name"], r["quantity"], r["unit"], r["confidence"]) for r in got] == [(1, 0, 7, "a", 2.0, "", 1.0), (2, 0, 7, "a", 0.0, "m", 1.0), (2, 5, 2, "d", 0.0, "", 1.0)]
    assert got[0]["bbox"]["y1"] == 4.0


def test_rooms(spark):
    def run(**given):
        df = spark.createDataFrame([{k: str(v) for k, v in given.items()}])
        return {r["location"].split()[-1]: (r["quantity"], r["confidence"]) for r in produce.room_items(produce.read_rooms(df, []), []).collect()}

    box = {"width_m": 4, "depth_m": 5, "height_m": 2.4}
    assert run(**box, openings_m2=5, exterior_wall_len_m=9) == {"壁": (16.6, 0.95), "天井": (20.0, 0.95), "床": (20.0, 0.95)}
    assert run(**box)["壁"] == (43.2, 0.6)
    assert run(floor_area_m2=22.7, wall_area_m2=40, surfaces="壁;床") == {"壁": (40.0, 0.95), "床": (22.7, 0.95)}
    assert run(name="x") == {} and run(幅=0, 奥行=5, wall_area="") == {}


def test_risers(spark):
    def run(**given):
        df = spark.createDataFrame([{k: str(v) for k, v in given.items()}])
        return [r["quantity"] for r in produce.riser_items(produce.read_risers(df, []), []).orderBy("pos").collect()]

    assert run(floors=5, floor_height_m=3.2, count=2, fittings_per_floor=2, valves_per_floor=1) == [32.0, 20.0, 10.0]
    assert run(floors=3, floor_height_m=3.0, branch_per_floor_m=4.0) == [9.0, 12.0, 6.0]
    assert run(floors=0, floor_height_m=3.0) == run(floor_height_m="bad", floors=2) == []


def test_measures(spark):
    def run(**given):
        r = produce.measure_items(spark.createDataFrame([{k: str(v) for k, v in given.items()}]), []).first()
        return r["name"], r["spec"], r["quantity"], r["unit"], r["location"]

    assert run(kind="角ダクト", width_mm=500, height_mm=400, length_m=10) == ("ダクト", "500×400 L10m", 18.0, "m2", "")
    assert run(kind="丸ダクト", dia_mm=200, length_m=10) == ("ダクト", "φ200 L10m", 6.28, "m2", "")
    assert run(length="2.5", 径=50) == ("ダクト", "φ50 L2.5m", round(math.pi * 0.05 * 2.5, 2), "m2", "")
    assert run(length_m=3, spec="SGP") == ("冷温水配管", "SGP", 3.0, "m", "")
    assert run(kind="台数", name="扇", 数量="３", 場所=" 2F ") == ("扇", None, 3.0, "台", "2F")
    assert run(name="?") == ("?", None, 0.0, "個", "")


def _rows(spark, rows):
    full = [(1, i, n, s, q, "個", None, c, None) for i, (n, s, q, c) in enumerate(rows)]
    return spark.createDataFrame(full, "page int, ord long, name string, spec string, quantity double, unit string, location string, confidence double, source string")


@pytest.mark.parametrize(
    ("vision", "table", "want"),
    [
        ([("弁", "GV", 1.0, 0.5)], [("弁", "GV", 2.0, 0.9)], [("弁", "GV", 2.0, 0.95, "reconciled")]),
        ([("弁", "GV", 1.0, 0.99)], [("ポンプ", "P1", 3.0, 0.9)], [("弁", "GV", 1.0, 0.99, None), ("ポンプ", "P1", 3.0, 0.9, "text_table")]),
        ([("仕切弁", "GV DN20", 4.0, 0.8)], [("x", "DN20", 5.0, 0.9)], [("仕切弁", "GV DN20", 5.0, 0.95, "reconciled")]),
        ([("仕切弁", None, 4.0, 0.8)], [("仕切弁 80A", "80A", 5.0, 0.9), ("y", "80A", 6.0, 0.9)], [("仕切弁", "80A", 6.0, 0.95, "reconciled")]),
        ([], [("a", None, 1.0, 0.9), ("a", None, 2.0, 0.9)], [("a", None, 2.0, 0.95, "reconciled")]),
        ([("弁", "GV", 1.0, 0.5)], [], [("弁", "GV", 1.0, 0.5, None)]),
    ],
)
def test_reconcile(spark, vision, table, want):
    got = reconcile.reconcile(_rows(spark, vision), _rows(spark, table), ["page"]).orderBy("ord").collect()
    assert [(r["name"], r["spec"], r["quantity"], r["confidence"], r["source"]) for r in got] == want


def test_dedupe_keeps_one_and_never_sums(spark):
    def run(rows):
        df = spark.createDataFrame([(1, i, None, n, s, loc, q, c) for i, (n, s, loc, q, c) in enumerate(rows)], "page int, ord long, category string, name string, spec string, location string, quantity double, confidence double")
        return [(r["name"], r["quantity"]) for r in items.dedupe_keep_best(df, ["page"], [F.col("ord")]).orderBy("first_ord").collect()]

    assert run([("a", "S 1", "x", 1.0, 0.9)] * 5) == [("a", 1.0)]
    assert run([("a", "s1", "x", 12.0, 0.8), ("b", "Ｓ１", "X ", 16.5, 0.6), ("c", " ", "x", 1.0, 0.1)]) == [("a", 12.0), ("c", 1.0)]
    assert run([("a", "s", "x", 3.0, 0.8), ("a", "s", "x", 2.0, 0.8), ("a", "s", "y", 1.0, 0.1)]) == [("a", 3.0), ("a", 1.0)]


def test_summary_of_mixed_units(spark):
    df = spark.createDataFrame([("a", "m", 1.0), ("a", "m", 2.0), ("b", "m", 1.0), ("b", "個", 1.0), (None, "m", 5.0)], "category string, unit string, quantity double")
    assert {tuple(r) for r in items.category_summary(df).collect()} == {("a", 2, 3.0, "m"), ("b", 2, None, "混在"), ("その他", 1, 5.0, "m")}


def test_accuracy(spark):
    kind = "name string, spec string, location string, quantity double, unit string, category string, ord int"
    found = spark.createDataFrame([("弁", "a", None, 1.0, "個", "x", 0), ("管 ", "b", None, 103.0, "m", "x", 1)], kind)
    truth = spark.createDataFrame([("弁", "A", "", 2.0, "個", "x", 0), ("管", "b", None, 100.0, "m", None, 1), ("ポンプ", None, None, 1.0, "台", "y", 2)], kind)
    ties = [F.col("ord")]
    m = accuracy.metrics(found, truth, ties).first()
    assert (m["precision"], round(m["recall"], 2), m["qty_match"]) == (1.0, 0.67, 1)
    assert accuracy.metrics(found, truth, ties, tolerance=0.02).first()["qty_match"] == 0
    missing = accuracy.only_in(truth, found, ties)
    assert [r["name"] for r in missing.collect()] == ["ポンプ"] and accuracy.only_in(found, truth, ties).count() == 0
    by = accuracy.metrics_by_category(found, truth, ties)
    assert {r["category"]: r["recall"] for r in by.collect()} == {"x": 1.0, "y": 0.0, "未分類": 1.0}
    assert "ポンプ" in reports.accuracy(accuracy.metrics(found, truth, ties), by, missing, missing.limit(0))
    assert accuracy.metrics(found.limit(0), truth.limit(0), ties).first()["f1"] == 0.0


def test_corrections_log(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert files.read_corrections(spark, path).count() == 0
    one = ("a", None, 1.0, "m", None, None)
    sinks.append_correction(spark, path, [("t", "p", "ui", "", one, ("a", None, 2.0, "m", None, None))])
    sinks.append_correction(spark, path, [("t", None, "ui", "", one, one)])
    log = files.read_corrections(spark, path)
    assert tuple(accuracy.correction_stats(log).first()) == (2, 1, 2)
    assert accuracy.training_pairs(log).columns == ["input", "label", "project", "ts"]


def test_diagnosis(spark):
    df = spark.createDataFrame([(1, "トイレが流れない 水位が上がる"), (2, "?"), (3, None)], "id int, text string")
    got = advice.diagnose(df, rules.jobs(spark), "text", ["id"])
    rows = got.orderBy("id", "rank").collect()
    assert [(r["job"], r["score"], r["price_min"], r["price_max"]) for r in rows if r["id"] == 1] == [("トイレつまり除去（軽度）", 3, 8_800, 19_800), ("排水つまり除去（台所・洗面）", 1, 8_800, 24_200)]
    assert [(r["job"], r["score"]) for r in rows if r["id"] > 1] == [("現地調査・点検", 0)] * 2
    assert "¥8,800〜¥19,800" in reports.quote_card("詰まり", got.filter("id = 1"))


def test_validation(spark, entries, tmp_path):
    assert validate.validate(entries).filter("severity = 'error'").count() == 0
    (tmp_path / "d.yaml").write_text("entries:\n- {canonical: 管, category: 給水, unit: m, aliases: [a1, a1, 管]}\n- {canonical: 弁, category: '', unit: x, aliases: [a1, 管, '']}\n", encoding="utf-8")
    loose = rule_files.dictionary(spark, str(tmp_path / "d.yaml"), strict=False)
    assert sorted(r["rule"] for r in validate.validate(loose).collect()) == sorted(["V2", "V6", "V7", "V8", "V9", "V10", "V10", "V10", "V10", "V10", "V11", "V11", "V12"])
    with pytest.raises(ValueError, match="V2"):
        rule_files.dictionary(spark, str(tmp_path / "d.yaml"))
    (tmp_path / "e.yaml").write_text("entries: [{canonical: 管}]", encoding="utf-8")
    with pytest.raises(ValueError, match="entry 0"):
        rule_files.dictionary(spark, str(tmp_path / "e.yaml"))


def test_rule_files(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("prices:\n- {unit_price: 10, unit: m, material_ratio: 7, spec: ' '}\n- text\n- {unit: m}\n", encoding="utf-8")
    p = rule_files.prices(spark, str(tmp_path / "p.yaml")).collect()
    assert len(p) == 1 and (p[0]["material_ratio"], p[0]["spec"]) == (1.0, None)
    (tmp_path / "l.yaml").write_text("default_years: 9\npipe_service_life: [{keywords: [x], label: X}]\nplans: [{name: a}]\n", encoding="utf-8")
    lives, plans, default = rule_files.lives_and_plans(spark, str(tmp_path / "l.yaml"))
    assert (lives.first()["years"], plans.first()["interval_months"], default) == (9, 12, 9)
    (tmp_path / "j.yaml").write_text("jobs: [{name: a, keywords: [b], price_min: 1}]\nfallback: {name: f}\n", encoding="utf-8")
    assert sorted(r["ord"] for r in rule_files.jobs(spark, str(tmp_path / "j.yaml")).collect()) == [-1, 0]
    assert rule_files.municipalities(spark, str(tmp_path / "none.yaml")).count() == 0
    (tmp_path / "i.yaml").write_text("owner: o\nother: 1\n", encoding="utf-8")
    assert rule_files.project(str(tmp_path / "i.yaml")) == {**dict.fromkeys(rule_files.PROJECT_KEYS, ""), "owner": "o", "work_type": "新設"}


def test_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"rooms": [{"name": "A", "floor_area_m2": 5, "surfaces": ["床", "天井"]}]}), encoding="utf-8")
    (tmp_path / "r.csv").write_text("﻿name,floor_area_m2,wall_area_m2,material,thickness_mm,surfaces\nB,6,7,m,100,壁;床\n", encoding="utf-8")
    a = produce.room_items(produce.read_rooms(files.read_json(spark, str(tmp_path / "r.json"), "rooms"), []), []).collect()
    b = produce.room_items(produce.read_rooms(files.read_csv(spark, str(tmp_path / "r.csv")), []), []).collect()
    assert [(r["location"], r["quantity"]) for r in a] == [("A 天井", 5.0), ("A 床", 5.0)]
    assert [(r["location"], r["quantity"], r["spec"]) for r in b] == [("B 壁", 7.0, "t100"), ("B 床", 6.0, "t100")]
    (tmp_path / "m.json").write_text('[{"kind": "個数", "count": 2}]', encoding="utf-8")
    assert files.read_json(spark, str(tmp_path / "m.json"), "measures").first()["count"] == "2"
    (tmp_path / "d.bin").write_bytes(b"x")
    pages = files.scan_documents(spark, str(tmp_path / "d.bin"), lambda content: iter([files.EMPTY_PAGE]))
    assert pages.first()["width"] == 1654.0
    asked = files.ask(pages.withColumn("q", F.lit("?")), lambda prompt: f"[{prompt}]", "q", ["page"])
    assert tuple(asked.first()) == (1, "[?]")


def test_takeoff_flow(spark, entries):
    pages = spark.createDataFrame([(1, 1, "仕切弁 GV 80A 5個")], "doc int, page int, text string")
    reply = '[{"name": "仕切弁", "spec": "GV 80A", "quantity": 4, "unit": "個", "confidence": 0.8}, {"name": "謎", "quantity": 1, "unit": "式"}]'
    replies = spark.createDataFrame([(1, 1, reply), (1, 1, reply)], "doc int, page int, reply string")
    got = flows.takeoff(pages, replies, entries, ["doc"], tiled=True).orderBy("ord").collect()
    assert [(r["name"], r["category"], r["quantity"], r["source"]) for r in got] == [("仕切弁", "弁類", 5.0, "reconciled"), ("謎", "その他", 1.0, None)]


def test_measured_flow(spark, entries):
    rule_set = flows.RuleSet(entries, rules.prices(spark), rules.lives(spark), rules.plans(spark))
    rows = spark.createDataFrame([(1, "仕切弁", "個数", "3")], "p int, name string, kind string, count string")
    lines, totals = flows.measured(rows, "measures", rule_set, ["p"], ["p"])
    assert totals.first()["total"] == 29_040 and lines.count() == 1


def test_geometry(spark):
    df = spark.createDataFrame([(1, [10.0, 5.0, 30.0, 40.0]), (2, None)], "page int, b array<double>").withColumn("bbox", scalar.bbox_from_array(F.col("b")))
    got = geometry.markers(df, df, ["page"], 144.0).collect()
    assert len(got) == 1 and tuple(got[0]["box"]) == (5.0, 2.5, 15.0, 20.0) and tuple(got[0]["label"]) == (5.0, 0.0, 185.0, 12.0)
    assert geometry.tiles(df, 2, F.lit(10.0), F.lit(4.0), ["page"]).filter("page = 1 and row = 1 and col = 0 and x1 = 5 and y0 = 2").count() == 1
    assert geometry.shrink_dpi(200, 5_000_000) == 150 and geometry.shrink_dpi(200, 1) == 200 and geometry.shrink_dpi(80, 5_000_000) == 72


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "project_id long, name string")
    new = spark.createDataFrame([(2, "n")], "project_id long, name string")
    done = spark.createDataFrame([(2,), (3,)], "project_id long")
    assert {tuple(r) for r in sinks.replace_items(table, new, done).collect()} == {(1, "a"), (2, "n")}
    path = f"{tmp_path}/t"
    sinks.write_replacing(spark, table, path)
    sinks.write_replacing(spark, new, path)
    assert {r["name"] for r in spark.read.parquet(path).collect()} == {"a", "n", "c"}
    merged = sinks.upsert(table.withColumn("v", F.lit(9)), new.withColumn("v", F.lit(1)), ["project_id"], F.col("v"))
    assert {r["project_id"]: r["name"] for r in merged.collect()} == {1: "a", 2: "n", 3: "c"}


def test_pictures_shrink_until_they_fit():
    asked = []

    def render(dpi):
        asked.append(dpi)
        return b"x" * int(dpi * 100)

    assert geometry.render_within(render, 200, limit=12_000) == (b"x" * 11_250, 112.5) and asked == [200, 150, 112.5]
    assert geometry.render_within(render, 80, limit=1)[1] == 72
