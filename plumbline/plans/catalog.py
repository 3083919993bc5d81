"""The queries over the driver's tables, with their SQL. Nothing here takes a part of a table only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.scalar import bbox_from_array, close_to_larger, close_to_truth, norm, number_text, spec_match, yen_text
from ..operators import accuracy, advice, extract, geometry, ledger, pricing, produce, reconcile, validate
from ..operators import items as items_of
from ..operators.classify import classify, number_within
from ..rules import DEFAULT_CATEGORY
from ..sources import files, sinks
from ..sources.shared import shared_path
from . import demo_rules as R
from . import reports
from .catalog_sql import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

UNITS = {"PROMO": "m", "MEDIUM": "個", "SMALL": "台", "STANDARD": "m", "LARGE": "m2", "ECONOMY": "個"}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takeoff items from order lines: a project is an order. key orders equal rows; rows that agree in it are alike."""
    line, part, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    df = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    unit = F.lit(None).cast("string")
    for k, v in UNITS.items():
        unit = F.when(F.col("p_type") == k, v).otherwise(unit)
    df = df.select(
        F.col("l_orderkey").alias("project_id"),
        F.col("l_linenumber").alias("page"),
        F.col("p_name").alias("name"),
        F.concat("p_brand", F.lit(" DN"), F.col("p_size").cast("string")).alias("spec"),
        F.col("l_quantity").alias("quantity"),
        unit.alias("unit"),
        F.col("n_name").alias("location"),
        F.lit(None).cast("string").alias("category"),
        (F.lit(1.0) - F.col("l_discount") * 5).alias("confidence"),
        F.when(F.col("l_returnflag") == "R", "reconciled").when(F.col("l_returnflag") == "A", "text_table").alias("source"),
        F.year("l_shipdate").alias("installed_year"),
        F.col("p_brand").alias("vendor_id"),
        F.col("l_linestatus").alias("status"),
    )
    return df


#: In this order rows of a page or project are told apart; rows that agree in all are alike.
TIES = ("page", "name", "spec", "quantity", "unit", "location", "confidence", "installed_year", "status")


def ties() -> list[Column]:
    return [F.col(c) for c in TIES]


def entries(spark: SparkSession, rows: tuple = R.DICTIONARY) -> DataFrame:
    return spark.createDataFrame([(i, c, k, u, list(a)) for i, (c, k, u, a) in enumerate(rows)], schema.DICTIONARY)


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r, "") for i, r in enumerate(R.PRICES)], schema.PRICE)


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *p, "") for i, p in enumerate(R.PLANS)], schema.PLAN)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(items(spark, sf_dir), entries(spark), unicode=False)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.amounts(pricing.quote(classified(spark, sf_dir), prices(spark), F.col("vendor_id")))


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lives = spark.createDataFrame([(i, list(k), y, label) for i, (k, y, label) in enumerate(R.LIVES)], schema.LIFE)
    return ledger.ledger(classified(spark, sf_dir), lives, F.col("installed_year"), R.CURRENT_YEAR, unicode=False)


@query
def flagship_estimate_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.totals(lines(spark, sf_dir), ["category"])


@query
def classify_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("project_id", "page", "name", "spec", "quantity", "unit", "category", "matched")


@query
def price_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir)
    return df.groupBy("category", F.col("vendor_id"), pricing.source_label(F.col("price")).alias("rule"), "unit_mismatch").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.sum("material").alias("material"), F.sum("labor").alias("labor"))


@query
def estimate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.totals(lines(spark, sf_dir), ["project_id"])


@query
def estimate_summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.estimate_book(lines(spark, sf_dir), ["location"], *TIES)["summary"].select("location", "pos", "label", "amount", yen_text(F.col("amount")).alias("shown"))


@query
def unpriced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.unpriced(lines(spark, sf_dir)).select("project_id", "page", "name", "spec", "quantity")


@query
def purchase_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.purchase_order_book(lines(spark, sf_dir), ["project_id"], *TIES)["lines"].select("project_id", "no", "category", "name", "spec", "quantity", "unit", "material")


@query
def material_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_of.material_by_category(pricing.order_lines(lines(spark, sf_dir)))


@query
def takeoff_list_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.takeoff_sheet(classified(spark, sf_dir), ["project_id"], *TIES).select("project_id", "no", "category", "name", "spec", "quantity", "unit", "page", "note")


@query
def estimate_list_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.estimate_sheet(lines(spark, sf_dir), ["project_id"], *TIES).select("project_id", "no", "category", "name", "quantity", "unit_price", "amount", "material", "labor", "note")


@query
def category_summary_mixed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_of.category_summary(classified(spark, sf_dir), ["location"])


@query
def pipe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_of.summarize_pipes(classified(spark, sf_dir), ("給水", "給湯"), ["location"])


@query
def supply_total_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipes = items_of.summarize_pipes(classified(spark, sf_dir), ("給水", "給湯"), ["location"])
    return pipes.groupBy("location").agg(F.sum("length").alias("total")).select("location", "total", number_text(F.col("total")).alias("shown"))


@query
def fixture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_of.summarize_fixtures(classified(spark, sf_dir), scope=["location"])


@query
def dedupe_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_of.dedupe_keep_best(items(spark, sf_dir), ["project_id"], ties(), unicode=False).select("project_id", "page", "name", "spec", "quantity", "location", F.bround("confidence", 4).alias("confidence"), F.col("first_ord.page").alias("first_page"))


@query
def ledger_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.ledger_sheet(ledger_rows(spark, sf_dir), ["project_id"], *TIES).select("project_id", "no", "category", "name", "label", "spec", "installed_year", "service_life", "recommend_year", "remaining", "state")


@query
def ledger_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.due(ledger_rows(spark, sf_dir)).groupBy("location", "label").agg(F.count(F.lit(1)).alias("n_due"), F.min("remaining").alias("least"))


@query
def plan_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.recommend_plan(ledger_rows(spark, sf_dir), plans(spark), ["project_id"])


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("p_type") == "LARGE", "m2").when(F.col("p_type") == "SMALL", "台").otherwise("m")
    size = F.col("p_size").cast("string")
    text = F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" DN"), size, F.lit(" ・ "), size, F.lit(".5"), unit, F.lit("\nno quantity here\n"), F.col("p_name"), F.lit(" 80A "), size, F.lit("個 / 3台\n7本"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


@query
def table_line_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.table_lines(table_pages(spark, sf_dir), "text", ["p_partkey"])


@query
def symbol_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    text = F.concat(F.lit("AND GR"), n, F.lit(" EI2-GR06 THE P02 lower a1 FCU-2 EI"), (F.col("p_size") % 10).cast("string"), F.lit("_X GR"), n)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", extract.symbol_codes(text)).alias("codes"))


@query
def page_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about pages, tiles and what a first pass has missed."""
    code = F.concat(F.lit("GR"), F.col("p_size").cast("string"))
    text = F.when(F.col("p_size") % 4 != 0, F.concat(F.col("p_name"), F.lit(" "), code, F.lit(" AHU1 "), F.repeat(F.lit("x"), F.col("p_size") * 300)))
    item = F.struct(F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, F.lower(code)).alias("spec"), F.lit("").alias("location"))
    found = F.when(F.col("p_size") % 5 != 0, F.array(item)).otherwise(F.array().cast("array<struct<name:string,spec:string,location:string>>"))
    rows = table(spark, sf_dir, "part").withColumns({"text": text, "found": found}).withColumn("codes", extract.symbol_codes(F.coalesce("text", F.lit(""))))
    size = F.col("p_size")
    return rows.select("p_partkey", files.page_prompt(size, F.col("text"), F.col("codes")).alias("whole"), files.tile_prompt(size, F.lit(0), F.lit(1), 2, F.col("text"), F.col("codes")).alias("tile"), files.check_prompt(size, F.col("text"), F.col("codes"), F.col("found")).alias("check"))


@query
def legend_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.concat(F.lit("SA 吹出口\nEA：吸込口\nDN20 配管\nTHE 図面\nVAV English\nSA 別名\n"), F.repeat(F.lit("SA-1 "), (k % 5).cast("int")), F.lit("XSA "), F.repeat(F.lit(" EA2"), (k % 3).cast("int")))
    return extract.legend_items(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), "text", ["s_suppkey"]).drop("line_no")


@query
def json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    n = F.col("p_size").cast("string")
    kinds = [
        F.concat(F.lit('```json\n[{"page": 2, "name": "'), name, F.lit('", "spec": "s", "quantity": '), n, F.lit(', "unit": "m", "location": "L", "bbox": [1, 2, 3, 4], "confidence": 0.5}]\n```')),
        F.concat(F.lit('[{"name": "'), name, F.lit('", "quantity": "'), n, F.lit('", "unit": "m", "confidence": 0}, 5, {"page": 0, "name": "x", "unit": "m"}]')),
        F.concat(F.lit('{"name": "'), name, F.lit('"}')),
        F.concat(F.lit('[{"name": "'), name),
        F.concat(F.lit('[{"name": "a", "unit": null, "quantity": 1}, {"page": "3", "name": "'), name, F.lit('", "quantity": null}, {"name": "q", "quantity": "many"}]')),
    ]
    raw = F.lit(None).cast("string")
    for i, k in enumerate(kinds):
        raw = F.when(F.col("p_partkey") % 5 == i, k).otherwise(raw)
    got = extract.json_items(table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")), "raw", ["p_partkey"], F.lit(9))
    return got.select("p_partkey", "pos", "page", "name", "spec", "quantity", "unit", "location", F.col("bbox.y1").alias("y1"), "confidence")


@query
def event_json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON rows with their numbers as quantities, from the events' properties."""
    ev = table(spark, sf_dir, "events")
    raw = F.concat(F.lit('[{"name": "'), F.col("event_type"), F.lit('", "unit": "k", "quantity": '), F.get_json_object("props", "$.k"), F.lit("}]"))
    got = extract.json_items(ev.select("event_id", "event_type", raw.alias("raw")), "raw", ["event_id"], F.lit(1))
    return got.groupBy("name", "unit").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


def measure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = F.col("p_type"), F.col("p_size")
    kinds = {"PROMO": "角ダクト", "MEDIUM": "丸ダクト", "SMALL": "配管", "LARGE": "台数", "ECONOMY": "個数"}
    kind = F.lit("")
    for k, v in kinds.items():
        kind = F.when(t == k, v).otherwise(kind)
    free = t == "STANDARD"

    def text(c: Column) -> Column:
        return c.cast("string")

    return table(spark, sf_dir, "part").select(
        "p_partkey",
        kind.alias("kind"),
        F.when(s % 2 == 0, F.col("p_name")).alias("name"),
        text(F.when(t == "PROMO", s * 10).when(free & (s % 3 == 0), s * 20)).alias("width_mm"),
        text(F.when(t == "PROMO", s * 5).when(free & (s % 3 == 0), s * 7)).alias("height_mm"),
        text(F.when(t.isin("MEDIUM", "SMALL"), s * 3).when(free & (s % 3 == 1), s * 2)).alias("dia_mm"),
        text(F.when(t.isin("LARGE", "ECONOMY"), F.lit(None)).otherwise(s % 9 + 1)).alias("length_m"),
        text(F.when(t.isin("LARGE", "ECONOMY"), s)).alias("count"),
        F.when(free & (s % 3 == 2), F.col("p_brand")).alias("spec"),
        F.lit(None).cast("string").alias("unit"),
        F.lit(None).cast("string").alias("confidence"),
        F.lit(" site ").alias("location"),
    )


@query
def measures_to_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return produce.measure_items(measure_rows(spark, sf_dir), ["p_partkey"])


def room_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")

    def some(condition: Column, value: Column) -> Column:
        return F.when(condition, value).cast("string")

    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_name").alias("室名"),
        some(s % 4 != 0, s / 4).alias("width_m"),
        some(s % 4 != 0, s / 8).alias("奥行"),
        some(s % 5 != 0, F.lit(2.5)).alias("height_m"),
        some(s % 7 == 0, s * 1.5).alias("floor_area_m2"),
        some(s % 11 == 0, s * 2.25).alias("wall_area_m2"),
        some(s % 2 == 0, F.lit(4.0)).alias("openings_m2"),
        some(s % 3 == 0, s / 2).alias("exterior_wall_len_m"),
        F.when(s % 6 == 0, " 壁 ; 床").when(s % 6 == 1, "天井、床").alias("surfaces"),
        some(s % 2 == 1, s).alias("thickness_mm"),
    )


@query
def rooms_to_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return produce.room_items(produce.read_rooms(room_rows(spark, sf_dir), ["p_partkey"]), ["p_partkey"])


def json_files(df: DataFrame, key: str, name: str, kind: str = "") -> str:
    """df as files that hold an array of a thousand keys' rows each, or an object with that array under `kind`."""
    path = shared_path(df.sparkSession, name)
    rows = df.groupBy(F.floor(F.col(key) / 1000).alias("file")).agg(F.sort_array(F.collect_list(F.struct(key, F.to_json(F.struct(*df.columns)).alias("j")))).alias("r"))
    body = F.concat(F.lit("["), F.concat_ws(",", "r.j"), F.lit("]"))
    body = F.concat(F.lit('{"' + kind + '": '), body, F.lit("}")) if kind else body
    rows.select("file", body.alias("value")).repartition("file").write.mode("overwrite").partitionBy("file").text(path)
    return path


@query
def json_source_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rooms written as JSON, read by the JSON source; a room's name is its key there."""
    rows = room_rows(spark, sf_dir).withColumn("室名", F.col("p_partkey").cast("string"))
    raw = files.read_json(spark, json_files(rows, "p_partkey", "rooms", "rooms"), "rooms").withColumn("p_partkey", F.col("室名").cast("long"))
    return produce.room_items(produce.read_rooms(raw, ["p_partkey"]), ["p_partkey"])


@query
def json_source_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.concat(F.lit('"'), "p_brand", F.lit('", \\ 径')).alias("spec"), F.col("p_size").alias("quantity"), F.when(F.col("p_size") % 2 == 0, "m").alias("unit"))
    got = files.read_json(spark, json_files(part, "p_partkey", "items"), "items")
    return got.groupBy("spec", "unit").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("quantity").cast("double")).alias("quantity"), F.max("ord").alias("last"))


@query
def csv_source_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "measures")
    sinks.write_sheet(measure_rows(spark, sf_dir), path)
    return produce.measure_items(files.read_csv(spark, path).withColumn("p_partkey", F.col("p_partkey").cast("long")), ["p_partkey"])


@query
def risers_to_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.lit("R").alias("name"),
        (k % 7).cast("string").alias("階数"),
        F.when(k % 5 != 0, F.lit("3.25")).alias("floor_height_m"),
        (k % 3).cast("string").alias("count"),
        F.when(k % 2 == 0, F.lit("DN50")).alias("spec"),
        F.when(k % 4 == 0, F.lit("1.5")).otherwise(F.lit("")).alias("branch_per_floor_m"),
        F.when(k % 6 == 0, F.lit("0.5")).alias("fittings_per_floor"),
        F.when(k % 8 == 0, F.lit("bad")).when(k % 8 == 1, F.lit("1")).alias("valves_per_floor"),
        F.when(k % 9 == 0, F.col("o_orderpriority")).alias("location"),
    )
    return produce.riser_items(produce.read_risers(rows, ["o_orderkey"]), ["o_orderkey"])


@query
def reconcile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of open orders as read off a drawing, closed ones as its table: by page, in order."""
    df = number_within(items(spark, sf_dir), ["project_id"], ties(), "ord").withColumn("ord", F.col("ord").cast("long"))
    return reconcile.reconcile(df.filter("status = 'O'"), df.filter("status = 'F'"), ["project_id"])


@query
def accuracy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir).withColumn("category", F.col("unit"))
    return accuracy.metrics(df.filter("status = 'O'"), df.filter("status = 'F'"), [F.col("project_id"), *ties()], unicode=False)


@query
def accuracy_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir).withColumn("category", F.col("unit"))
    return accuracy.metrics_by_category(df.filter("status = 'O'"), df.filter("status = 'F'"), [F.col("project_id"), *ties()], unicode=False)


@query
def missing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    return accuracy.only_in(df.filter("status = 'F'"), df.filter("status = 'O'"), [F.col("project_id"), *ties()], unicode=False).select("project_id", "name", "spec", "location", "quantity")


@query
def extra_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    return accuracy.only_in(df.filter("status = 'O'"), df.filter("status = 'F'"), [F.col("project_id"), *ties()], unicode=False).select("project_id", "name", "spec", "location", "quantity")


@query
def uncovered_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir).withColumn("k", norm(F.col("spec"), False))
    codes = df.filter("status = 'F'").select("location", "k", F.col("spec").alias("code")).distinct()
    return extract.uncovered_codes(codes, df.filter("status = 'O'"), ["location"]).select("location", "code")


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, u = F.col("value"), F.col("user_id")

    def side(q: Column) -> Column:
        return F.struct(F.col("event_type").alias("name"), F.lit(None).cast("string").alias("spec"), q.alias("quantity"), F.lit("m").alias("unit"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("category"))

    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").cast("string").alias("ts"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("project"), F.lit("ui").alias("source"), F.lit("").alias("note"), side(F.when(u % 5 != 0, v)).alias("before"), side(F.when(u % 5 != 0, F.when(u % 3 == 0, v).otherwise(v + 1)).otherwise(F.when(u % 2 == 0, v))).alias("after"))


@query
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.correction_stats(corrections(spark, sf_dir))


@query
def corrections_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrections appended to a log in two parts and read back."""
    path, all_ = shared_path(spark, "corrections"), corrections(spark, sf_dir)
    for part in (F.col("source") == "ui", F.col("source") != "ui"):
        all_.filter(part).write.mode("append").json(path)
    return accuracy.correction_stats(files.read_corrections(spark, path))


@query
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.training_pairs(corrections(spark, sf_dir)).select("project", "ts", F.col("input.quantity").alias("before"), F.col("label.quantity").alias("after"))


@query
def diagnose_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = spark.createDataFrame([(i, n, list(k), lo, hi, "", w) for i, (n, k, lo, hi, w) in [(-1, R.FALLBACK), *enumerate(R.JOBS)]], schema.JOB)
    return advice.diagnose(table(spark, sf_dir, "documents"), jobs, "text", ["doc_id"], unicode=True)


@query
def resolve_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = spark.createDataFrame([(i, n, list(a), f, o, "", [], "") for i, (n, a, f, o) in [(-1, R.DEFAULT_MUNICIPALITY), *enumerate(R.MUNICIPALITIES)]], schema.MUNICIPALITY)
    return advice.resolve_authority(table(spark, sf_dir, "nation"), places, "n_name").select("n_name", "form_name", "authority")


@query
def classify_fullwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in full-width letters find the same entries as plain ones."""
    plain = "".join(map(chr, range(0x21, 0x7F)))
    wide = F.translate("name", plain + " ", "".join(chr(ord(c) + 0xFEE0) for c in plain) + "\u3000")
    got = classify(items(spark, sf_dir).withColumn("name", wide), entries(spark))
    return got.groupBy("category", "matched", "unit").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.countDistinct("name").alias("names"))


@query
def specs_and_tolerances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts' names agree with their brand and type as specs do, and which sizes are near the next key's size class."""
    a, b = norm(F.col("p_name"), False), norm(F.concat(F.element_at(F.split("p_name", " "), 2), F.lit(" "), F.col("p_brand")), False)
    short = norm(F.element_at(F.split("p_name", " "), -1), False)
    size, other = F.col("p_size").cast("double"), (F.col("p_size") + F.col("p_partkey") % 3).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", spec_match(a, b).alias("brand_in"), spec_match(a, short).alias("word_in"), close_to_larger(size, other).alias("near_larger"), close_to_truth(other, size).alias("near_truth"))


def report(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.split("\n"))], "line long, text string")


@query
def application_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draft of an application over all items, line by line."""
    rows = classified(spark, sf_dir)
    form = {"form_name": "form", "authority": "office", "submit": "", "documents": ["plan", "list"], "notes": ""}
    project = dict.fromkeys(("contractor_name", "contractor_number", "chief_engineer", "project_name", "address", "owner"), "x") | {"work_type": "new"}
    return report(spark, reports.application(project, form, items_of.summarize_pipes(rows, ("給水", "給湯")), items_of.summarize_pipes(rows, ("排水",)), items_of.summarize_fixtures(rows)))


@query
def quote_card_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card of prices for the jobs that most documents speak of."""
    every = diagnose_text(spark, sf_dir).groupBy("job", "price_min", "price_max", "warranty_months").agg(F.count(F.lit(1)).alias("n"))
    top = every.orderBy(F.desc("n"), "job").limit(3)
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "job")))  # three rows
    return report(spark, reports.quote_card("", ranked))


@query
def maintenance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proposal over the ledger of all items, a line for each label and year of installation."""
    years = ["label", "installed_year", "service_life", "recommend_year", "remaining"]
    rows = ledger_rows(spark, sf_dir).groupBy(*years).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumns({"name": F.concat("label", F.lit(" x"), F.col("n").cast("string")), "spec": F.lit(None).cast("string")})
    return report(spark, reports.maintenance(rows, plans(spark), R.PLANS[1][0], 1992, R.CURRENT_YEAR, "company"))


@query
def accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics, the metrics of each category, and the first ten missing and extra items."""
    df = items(spark, sf_dir).withColumn("category", F.col("unit"))
    found, truth, order = df.filter("status = 'O'"), df.filter("status = 'F'"), [F.col("project_id"), *ties()]
    missing, extra = (accuracy.only_in(x, y, order, unicode=False) for x, y in ((truth, found), (found, truth)))
    return report(spark, reports.accuracy(accuracy_metrics(spark, sf_dir), accuracy_by_category(spark, sf_dir), missing, extra))


@query
def session_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified items dumped as a session and loaded again, with what is null in them."""
    path = shared_path(spark, "session")
    rows = classified(spark, sf_dir)
    sinks.dump_session(rows, path)
    back = files.load_session(spark, path, rows.schema)
    return back.groupBy("category", "source", "unit").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("project_id").alias("projects"), F.sum("quantity").alias("quantity"), F.min("confidence").alias("least"), F.max("spec").alias("spec"))


@query
def dictionary_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(entries(spark, R.FAULTY))


@query
def text_layer_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.text_layer(table(spark, sf_dir, "documents"), "text", ["source"], 100_000)


@query
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    return geometry.tiles(table(spark, sf_dir, "pages"), 3, (k % 7 * 90 + 900).cast("double"), F.lit(1200.0), ["page_id"])


@query
def bbox_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.when(F.col("vec_id") % 3 != 0, F.transform(F.slice("embedding", 1, 4), lambda x: (x * 100).cast("double")))
    category = F.when(F.col("vec_id") % 4 == 0, "床").when(F.col("vec_id") % 4 == 1, "?")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("page"), bbox_from_array(box).alias("bbox"), category.alias("category"))
    pages = rows.filter("page % 2 = 0").select("page").distinct()
    out = geometry.markers(rows, pages, ["page"], 200.0)
    return out.select("vec_id", "page", F.col("colour.b").alias("blue"), *[F.round(F.col(f"{s}.{c}"), 4).alias(f"{s}_{c}") for s in ("box", "label") for c in ("x0", "y0", "x1", "y1")])


@query
def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("org_id", F.col("c_nationkey").cast("long"))
    member = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 4).cast("long").alias("user_id"), F.col("n_nationkey").cast("long").alias("org_id"))
    return items_of.in_tenant(orders, member, 1).select("o_orderkey", "org_id")


@query
def replace_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir).select("project_id", "name", "quantity", "status")
    new = df.filter("status = 'O' and project_id % 3 = 0")
    projects = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("project_id"))
    return sinks.replace_items(df.filter("status = 'F'"), new, projects).groupBy("project_id", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query
def upsert_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("org_id"), (F.col("o_custkey") % 40).alias("slug"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    return sinks.upsert(orders.filter("status = 'F'"), orders.filter("status = 'P'"), ["org_id", "slug"], F.col("version"))


@query
def item_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = classified(spark, sf_dir).filter(F.col("category") != DEFAULT_CATEGORY)
    return sinks.json_rows(df, ["project_id"]).groupBy(F.get_json_object("json", "$.category").alias("category"), F.get_json_object("json", "$.unit").alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("json", "$.quantity").cast("double")).alias("quantity"))


__all__ = ["ORACLES", "QUERIES"]
