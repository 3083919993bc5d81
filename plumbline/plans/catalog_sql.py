"""The catalogue's queries in SQL, written apart from the operators: what a DuckDB session over the same tables gives."""

from __future__ import annotations

from . import demo_rules as R


def _lit(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    if isinstance(x, int):
        return str(x)
    return "'" + str(x).replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_lit(x) for x in r) + ")" for r in rows) + ")"


_KEYS = [(i * 1000 + j, k.replace(" ", ""), c, cat, u) for i, (c, cat, u, aliases) in enumerate(R.DICTIONARY) for j, k in enumerate((c, *aliases))]
_PRICES = [(i, *r) for i, r in enumerate(R.PRICES)]
_LIVES = [(i, k, y, label) for i, (ks, y, label) in enumerate(R.LIVES) for k in ks]
_TIES = "page, name, spec, quantity, unit, location, confidence, installed_year, status"

_ITEMS = """
items AS (
  SELECT l_orderkey AS project_id, l_linenumber AS page, p_name AS name, p_brand || ' DN' || p_size AS spec, l_quantity AS quantity,
    CASE p_type WHEN 'PROMO' THEN 'm' WHEN 'MEDIUM' THEN '個' WHEN 'SMALL' THEN '台' WHEN 'STANDARD' THEN 'm' WHEN 'LARGE' THEN 'm2' WHEN 'ECONOMY' THEN '個' END AS unit,
    n_name AS location, 1::DOUBLE - l_discount * 5 AS confidence, CASE l_returnflag WHEN 'R' THEN 'reconciled' WHEN 'A' THEN 'text_table' END AS source,
    year(l_shipdate)::INT AS installed_year, p_brand AS vendor_id, l_linestatus AS status
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""

_CLASSIFIED = f"""{_ITEMS},
keys AS (SELECT * FROM {_values(_KEYS)} AS k(ord, key, canonical, category, key_unit)),
names AS (SELECT DISTINCT name, replace(lower(name), ' ', '') AS n FROM items),
looked AS (
  SELECT name, (SELECT min(ord) FROM keys WHERE key = n) AS exact, (SELECT min(ord) FROM keys WHERE length(key) >= 3 AND contains(n, key)) AS part FROM names
),
classified AS (
  SELECT items.* EXCLUDE (name), coalesce(k.canonical, items.name) AS name, coalesce(k.category, 'その他') AS category,
    CASE WHEN exact IS NOT NULL THEN 'exact' WHEN part IS NOT NULL THEN 'partial' ELSE 'default' END AS matched
  FROM items JOIN looked USING (name) LEFT JOIN keys k ON k.ord = coalesce(exact, part)
)"""

_LINES = f"""{_CLASSIFIED},
rules AS (SELECT * FROM {_values(_PRICES)} AS r(ord, unit_price, rule_unit, ratio, r_spec, r_category, r_name, r_vendor)),
wanted AS (SELECT DISTINCT vendor_id, spec, category, name FROM classified),
ranked AS (
  SELECT w.*, r.*, row_number() OVER (PARTITION BY vendor_id, spec, category, name ORDER BY
    CASE WHEN r_vendor IS NULL THEN 0 ELSE 8 END + CASE WHEN r_spec IS NULL THEN 0 ELSE 4 END + CASE WHEN r_category IS NULL THEN 0 ELSE 2 END + CASE WHEN r_name IS NULL THEN 0 ELSE 1 END DESC, ord) AS rn
  FROM wanted w JOIN rules r ON (r_vendor IS NULL OR r_vendor = vendor_id) AND (r_spec IS NULL OR r_spec = spec) AND (r_category IS NULL OR r_category = category) AND (r_name IS NULL OR r_name = name)
),
lines AS (
  SELECT c.*, p.unit_price, p.rule_unit, p.ratio, p.r_spec, p.r_category, p.r_name, p.r_vendor,
    coalesce(round_even(p.unit_price * quantity, 0), 0)::BIGINT AS amount, coalesce(round_even(p.unit_price * quantity * ratio, 0), 0)::BIGINT AS material,
    coalesce(round_even(p.unit_price * quantity * (1::DOUBLE - ratio), 0), 0)::BIGINT AS labor
  FROM classified c LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) p ON p.vendor_id = c.vendor_id AND p.spec = c.spec AND p.category = c.category AND p.name = c.name
)"""


def _totals(key: str) -> str:
    return f"""WITH {_LINES},
s AS (SELECT {key}, count(*) AS n_lines, sum(amount)::BIGINT AS subtotal, sum(material)::BIGINT AS material, sum(labor)::BIGINT AS labor FROM lines GROUP BY {key}),
o AS (SELECT *, round_even(subtotal * 0.1::DOUBLE, 0)::BIGINT AS overhead FROM s),
t AS (SELECT *, subtotal + overhead AS total_ex_tax, round_even((subtotal + overhead) * 0.1::DOUBLE, 0)::BIGINT AS tax FROM o)"""


_LEDGER = f"""{_CLASSIFIED},
lives AS (SELECT * FROM {_values(_LIVES)} AS v(ord, word, years, label)),
hays AS (SELECT DISTINCT name, spec, lower(replace(name || ' ' || spec, ' ', '')) AS hay FROM classified),
lived AS (SELECT name, spec, (SELECT min(ord) FROM lives WHERE contains(hay, word)) AS ord FROM hays),
ledger AS (
  SELECT c.*, coalesce(v.label, '（標準）') AS label, coalesce(v.years, 20) AS service_life, installed_year + coalesce(v.years, 20) AS recommend_year,
    installed_year + coalesce(v.years, 20) - {R.CURRENT_YEAR} AS remaining
  FROM classified c JOIN lived USING (name, spec) LEFT JOIN (SELECT DISTINCT ord, years, label FROM lives) v USING (ord)
  WHERE unit = 'm' OR category IN ('機器', '衛生器具')
)"""

_LIST = "coalesce(nullif(category, ''), 'zzz'), page, name"


def _sides(category: bool = False) -> str:
    def side(name: str, status: str) -> str:
        return f"""{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY project_id, {_TIES}) AS rn FROM keyed WHERE status = '{status}') WHERE rn = 1
)"""

    return f"""{_ITEMS},
keyed AS (SELECT *, lower(replace(name, ' ', '')) || chr(31) || lower(replace(spec, ' ', '')) || chr(31) || lower(replace(location, ' ', '')) AS key FROM items),
{side("ai", "O")}, {side("truth", "F")},
m AS (
  SELECT t.unit AS category, a.key IS NOT NULL AS matched, coalesce(a.quantity = t.quantity OR (t.quantity <> 0 AND abs(a.quantity - t.quantity) <= 0.05::DOUBLE * abs(t.quantity)), false) AS ok
  FROM truth t LEFT JOIN ai a USING (key)
)"""


_DUCT = "round_even((w + h) * 2.0::DOUBLE / 1000.0::DOUBLE * l, 2)"
_ROUND = "round_even(3.141592653589793::DOUBLE * (d / 1000.0::DOUBLE) * l, 2)"
_JOBS = [(i, n, lo, hi, w) for i, (n, _, lo, hi, w) in enumerate(R.JOBS)]
_WORDS = [(i, k) for i, (_, ks, *_x) in enumerate(R.JOBS) for k in ks]
_PLACES = [(i, a, f, o) for i, (n, names, f, o) in enumerate(R.MUNICIPALITIES) for a in (n, *names) if a]
_ENTRIES = [(i, *e[:3]) for i, e in enumerate(R.FAULTY)]
_ALIASES = [(i, j, e[0], a) for i, e in enumerate(R.FAULTY) if e[0] for j, a in enumerate(e[3])]
_CORRECTIONS = """
c AS (
  SELECT event_id::VARCHAR AS ts, CASE WHEN event_type <> 'error' THEN event_type END AS project, CASE WHEN user_id % 5 <> 0 THEN value END AS before,
    CASE WHEN user_id % 5 <> 0 THEN CASE WHEN user_id % 3 = 0 THEN value ELSE value + 1 END ELSE CASE WHEN user_id % 2 = 0 THEN value END END AS after FROM events
)"""



def _plain(x: str) -> str:
    return f"replace(lower(coalesce({x}, '')), ' ', '')"


def _alike(a: str, b: str) -> str:
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR (least(length({a}), length({b})) >= 3 AND (contains({a}, {b}) OR contains({b}, {a})))))"


def _row(**fields: str) -> str:
    own = {c: f"s.{c}" for c in ("ord", "name", "spec", "quantity", "unit", "location", "confidence", "source")}
    return "struct_pack(" + ", ".join(f"{k} := {fields.get(k, v)}" for k, v in own.items()) + ")"


#: Rows of a page fold one after another into the page: the spec finds its row, else the name, else the row is new.
_RECONCILE = f"""WITH RECURSIVE {_ITEMS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {_TIES}) AS ord FROM items),
pages AS (
  SELECT project_id, coalesce(list({_row()} ORDER BY s.ord) FILTER (s.status = 'O'), []) AS page, coalesce(list({_row()} ORDER BY s.ord) FILTER (s.status = 'F'), []) AS tab FROM numbered s GROUP BY project_id
),
fold AS (
  SELECT project_id, page, tab, 0 AS k FROM pages
  UNION ALL
  SELECT project_id, CASE WHEN place IS NULL THEN list_append(page, {_row(**{c: f"t.{c}" for c in ("name", "spec", "quantity", "unit", "location", "confidence")}, ord="coalesce(list_max(list_transform(page, lambda s: s.ord)), -1) + 1", source="'text_table'")})
    ELSE list_transform(page, lambda s, i: CASE WHEN i = place THEN {_row(spec="CASE WHEN t.spec <> '' AND coalesce(trim(s.spec), '') = '' THEN t.spec ELSE s.spec END", quantity="t.quantity", confidence="greatest(s.confidence, 0.95::DOUBLE)", source="'reconciled'")} ELSE s END) END, tab, k + 1
  FROM (
    SELECT *, coalesce(nullif(list_position(list_transform(page, lambda s: {_alike(_plain("s.spec"), _plain("t.spec"))}), true), 0),
      nullif(list_position(list_transform(page, lambda s: {_plain("s.name")} <> '' AND {_plain("t.name")} <> '' AND ({_plain("s.name")} = {_plain("t.name")} OR (length({_plain("s.name")}) >= 3 AND contains({_plain("t.name")}, {_plain("s.name")})))), true), 0)) AS place
    FROM (SELECT *, tab[k + 1] AS t FROM fold WHERE k < len(tab))
  )
)
SELECT project_id, unnest(page, recursive := true) FROM fold WHERE k = len(tab)"""

_PIPE_LINES = """
pipes AS (
  SELECT category AS system, 'DN' || regexp_extract(spec, 'DN(\\d{1,3})', 1) AS caliber, sum(quantity) AS length, string_agg(DISTINCT split_part(spec, ' ', 1), '、' ORDER BY split_part(spec, ' ', 1)) AS material
  FROM classified WHERE category IN ('給水', '給湯', '排水') AND unit = 'm' GROUP BY 1, 2
), fixtures AS (SELECT name, sum(quantity) AS quantity FROM classified WHERE category = '衛生器具' GROUP BY name),
pipe_lines AS (SELECT system <> '排水' AS wet, system, caliber, '| ' || system || ' | ' || caliber || ' | ' || material || ' | ' || length::BIGINT || ' |' AS text FROM pipes)"""


def _pipe_section(where: str) -> str:
    return f"""coalesce(['| 系統 | 口径 | 管種 | 延長(m) |', '| --- | --- | --- | --- |'] || (SELECT list(text ORDER BY system, caliber) FROM pipe_lines WHERE {where}), ['（該当なし）'])"""


_CARD_TAIL = ", ".join(f"'- {x}:'" for x in ("実施作業", "使用部材", "写真", "実施金額", "保証期間", "担当者"))

ORACLES: dict[str, str] = {
    "flagship_estimate_by_category": f"{_totals('category')} SELECT category, n_lines, subtotal, material, labor, overhead, total_ex_tax, tax, total_ex_tax + tax AS total FROM t",
    "classify_items": f"WITH {_CLASSIFIED} SELECT project_id, page, name, spec, quantity, unit, category, matched FROM classified",
    "price_specificity": f"""WITH {_LINES}
SELECT category, vendor_id, CASE WHEN unit_price IS NULL THEN '' ELSE concat_ws(', ', 'vendor=' || r_vendor, 'spec=' || r_spec, 'cat=' || r_category, 'name=' || r_name) END AS rule,
  coalesce(rule_unit <> unit, false) AS unit_mismatch, count(*) AS n, sum(amount)::BIGINT AS amount, sum(material)::BIGINT AS material, sum(labor)::BIGINT AS labor FROM lines GROUP BY ALL""",
    "estimate_totals": f"{_totals('project_id')} SELECT project_id, n_lines, subtotal, material, labor, overhead, total_ex_tax, tax, total_ex_tax + tax AS total FROM t",
    "estimate_summary_rows": f"""{_totals('location')}, u AS (
  SELECT location, 0 AS pos, '小計' AS label, subtotal AS amount FROM t UNION ALL SELECT location, 1, '諸経費', overhead FROM t
  UNION ALL SELECT location, 2, '消費税', tax FROM t UNION ALL SELECT location, 3, '合計', total_ex_tax + tax FROM t)
SELECT location, pos, label, amount, '¥' || format('{{:,}}', amount) AS shown FROM u""",
    "unpriced_lines": f"WITH {_LINES} SELECT project_id, page, name, spec, quantity FROM lines WHERE unit_price IS NULL",
    "purchase_order": f"""WITH {_LINES}
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(nullif(category, ''), 'zzz'), name, {_TIES})::INT AS no, category, name, spec, quantity, unit, material
FROM lines WHERE unit_price IS NOT NULL AND material > 0""",
    "material_by_category": f"WITH {_LINES} SELECT category, count(*) AS n_lines, sum(material)::BIGINT AS material FROM lines WHERE unit_price IS NOT NULL AND material > 0 GROUP BY category",
    "takeoff_list_numbered": f"""WITH {_CLASSIFIED}
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY {_LIST}, {_TIES})::INT AS no, category, name, spec, quantity, unit, page,
  CASE WHEN confidence < 0.7::DOUBLE THEN printf('要確認(信頼度%.2f)', confidence) WHEN source = 'reconciled' THEN '機器表で数量確定' WHEN source = 'text_table' THEN '機器表から抽出' ELSE '' END AS note FROM classified""",
    "estimate_list_numbered": f"""WITH {_LINES}
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(nullif(category, ''), 'zzz'), name, {_TIES})::INT AS no, category, name, quantity, unit_price, amount, material, labor,
  CASE WHEN unit_price IS NULL THEN '単価未設定' WHEN confidence >= 0.7::DOUBLE THEN '' ELSE printf('要確認(信頼度%.2f)', confidence) END AS note FROM lines""",
    "category_summary_mixed_units": f"""WITH {_CLASSIFIED}
SELECT location, category, count(*) AS n_items, CASE WHEN count(DISTINCT unit) = 1 THEN sum(quantity) END AS quantity, CASE WHEN count(DISTINCT unit) = 1 THEN min(unit) ELSE '混在' END AS unit FROM classified GROUP BY location, category""",
    "pipe_summary": f"""WITH {_CLASSIFIED}
SELECT location, category AS system, 'DN' || regexp_extract(spec, 'DN(\\d{{1,3}})', 1) AS caliber, sum(quantity) AS length, string_agg(DISTINCT split_part(spec, ' ', 1), '、' ORDER BY split_part(spec, ' ', 1)) AS material
FROM classified WHERE category IN ('給水', '給湯') AND unit = 'm' GROUP BY 1, 2, 3""",
    "supply_total_length": f"""WITH {_CLASSIFIED}
SELECT location, sum(quantity) AS total, sum(quantity)::BIGINT::VARCHAR AS shown FROM classified WHERE category IN ('給水', '給湯') AND unit = 'm' GROUP BY location""",
    "fixture_summary": f"WITH {_CLASSIFIED} SELECT location, name, sum(quantity) AS quantity FROM classified WHERE category = '衛生器具' GROUP BY location, name",
    "dedupe_keep_best": f"""WITH {_ITEMS},
k AS (SELECT *, lower(replace(spec, ' ', '')) || chr(31) || lower(replace(location, ' ', '')) AS key FROM items),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id, key ORDER BY confidence DESC, {_TIES}) AS rn, min(page) OVER (PARTITION BY project_id, key) AS first_page FROM k)
SELECT project_id, page, name, spec, quantity, location, round_even(confidence, 4) AS confidence, first_page FROM r WHERE rn = 1""",
    "ledger_numbered": f"""WITH {_LEDGER}
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY remaining, {_TIES})::INT AS no, category, name, label, spec, installed_year, service_life, recommend_year, remaining,
  CASE WHEN remaining <= 0 THEN '★更新時期' WHEN remaining <= 5 THEN '要注意' ELSE '' END AS state FROM ledger""",
    "ledger_due": f"WITH {_LEDGER} SELECT location, label, count(*) AS n_due, min(remaining) AS least FROM ledger WHERE remaining <= 0 GROUP BY location, label",
    "plan_recommendation": f"""WITH {_LEDGER}
SELECT project_id, min(remaining) AS min_remaining, count(*) AS n_rows, CASE WHEN min(remaining) <= 0 THEN 'premium' WHEN min(remaining) <= 5 THEN 'standard' ELSE 'light' END AS plan FROM ledger GROUP BY project_id""",
    "table_line_extract": """
SELECT p_partkey, 0 AS line_no, p_name || ' ' || p_brand || ' DN' || p_size AS name, 'DN' || p_size AS spec, p_size + 0.5::DOUBLE AS quantity,
  CASE p_type WHEN 'LARGE' THEN 'm2' WHEN 'SMALL' THEN '台' ELSE 'm' END AS unit, 0.9::DOUBLE AS confidence FROM part
UNION ALL SELECT p_partkey, 2, p_name || ' 80A', '80A', p_size::DOUBLE, '個', 0.9::DOUBLE FROM part""",
    "symbol_codes": r"""
WITH t AS (SELECT p_partkey, 'AND GR' || p_size || ' EI2-GR06 THE P02 lower a1 FCU-2 EI' || p_size % 10 || '_X GR' || p_size AS text FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b([A-Z]{1,4}[0-9]{1,2}[-_]?[A-Z0-9]{0,4})\b', 1))), ',') AS codes FROM t""",
    "page_prompts": r"""
WITH p AS (
  SELECT p_partkey, p_size AS s, 'GR' || p_size AS code, CASE WHEN p_size % 4 <> 0 THEN p_name || ' GR' || p_size || ' AHU1 ' || repeat('x', p_size * 300) END AS text,
    CASE WHEN p_size % 5 = 0 THEN '  (なし)' ELSE '  - ' || p_name || ' / spec=' || CASE WHEN p_size % 3 = 0 THEN 'gr' || p_size ELSE '-' END || ' / loc=-' END AS found FROM part
), c AS (
  SELECT *, CASE WHEN text IS NULL THEN '' ELSE E'\n\n## 記号コード\nAHU1, ' || code END AS codes,
    CASE WHEN text IS NULL THEN '' WHEN s % 5 <> 0 AND s % 3 = 0 THEN E'\n\n## 未抽出の記号コード\nAHU1' ELSE E'\n\n## 未抽出の記号コード\nAHU1, ' || code END AS missing FROM p
)
SELECT p_partkey, '## ページ ' || s || E'\n項目を JSON 配列で。\nテキスト層: ' || coalesce(left(text, 8000), '(なし)') || codes AS whole,
  '## ページ ' || s || ' タイル 2x2 (1, 2)' || E'\n項目を JSON 配列で。\nテキスト層: ' || coalesce(left(text, 2000), '(なし)') || codes AS tile,
  '## ページ ' || s || E' 追加漏れ確認\n抽出済み:\n' || found || missing || E'\n載っていない項目を JSON 配列で。\nテキスト層: ' || coalesce(left(text, 2000), '(なし)') AS "check" FROM c""",
    "legend_counts": """
WITH k AS (SELECT s_suppkey, s_suppkey % 5 AS sa, s_suppkey % 3 AS ea FROM supplier)
SELECT s_suppkey, '吹出口' AS name, 'SA' AS spec, (sa + 1)::DOUBLE AS quantity, '個' AS unit, 0.7::DOUBLE AS confidence, 'legend_count' AS source FROM k
UNION ALL SELECT s_suppkey, '吸込口', 'EA', ea::DOUBLE, '個', 0.7::DOUBLE, 'legend_count' FROM k WHERE ea > 0""",
    "json_items": """
SELECT p_partkey, 0 AS pos, 2 AS page, p_name AS name, 's' AS spec, p_size::DOUBLE AS quantity, 'm' AS unit, 'L' AS location, 4.0::DOUBLE AS y1, 0.5::DOUBLE AS confidence FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey, 0, 9, p_name, NULL, p_size::DOUBLE, 'm', NULL, NULL, 1.0::DOUBLE FROM part WHERE p_partkey % 5 = 1
UNION ALL SELECT p_partkey, 1, 3, p_name, NULL, 0.0::DOUBLE, '', NULL, NULL, 1.0::DOUBLE FROM part WHERE p_partkey % 5 = 4""",
    "event_json_values": "SELECT event_type AS name, 'k' AS unit, count(*) AS n, sum((props::JSON->>'$.k')::DOUBLE) AS quantity FROM events GROUP BY event_type",
    "measures_to_items": f"""
WITH m AS (
  SELECT p_partkey, p_type AS t, p_size AS s, CASE WHEN p_size % 2 = 0 THEN p_name END AS n, CASE WHEN p_type = 'PROMO' THEN p_size * 10 WHEN p_type = 'STANDARD' AND p_size % 3 = 0 THEN p_size * 20 END::DOUBLE AS w,
    CASE WHEN p_type = 'PROMO' THEN p_size * 5 WHEN p_type = 'STANDARD' AND p_size % 3 = 0 THEN p_size * 7 END::DOUBLE AS h, CASE WHEN p_type IN ('MEDIUM', 'SMALL') THEN p_size * 3 WHEN p_type = 'STANDARD' AND p_size % 3 = 1 THEN p_size * 2 END::DOUBLE AS d,
    (p_size % 9 + 1)::DOUBLE AS l, p_brand FROM part
)
SELECT p_partkey, coalesce(n, CASE WHEN t IN ('PROMO', 'MEDIUM') OR (t = 'STANDARD' AND s % 3 <> 2) THEN 'ダクト' WHEN t IN ('SMALL', 'STANDARD') THEN '冷温水配管' ELSE '項目' END) AS name,
  CASE WHEN t = 'PROMO' OR (t = 'STANDARD' AND s % 3 = 0) THEN w::BIGINT || '×' || h::BIGINT || ' L' || l::BIGINT || 'm' WHEN t = 'MEDIUM' OR (t = 'STANDARD' AND s % 3 = 1) THEN 'φ' || d::BIGINT || ' L' || l::BIGINT || 'm'
    WHEN t = 'SMALL' THEN d::BIGINT || 'A' WHEN t = 'STANDARD' THEN p_brand END AS spec,
  CASE WHEN t = 'PROMO' OR (t = 'STANDARD' AND s % 3 = 0) THEN {_DUCT} WHEN t = 'MEDIUM' OR (t = 'STANDARD' AND s % 3 = 1) THEN {_ROUND} WHEN t IN ('SMALL', 'STANDARD') THEN l ELSE s::DOUBLE END AS quantity,
  CASE WHEN t IN ('PROMO', 'MEDIUM') OR (t = 'STANDARD' AND s % 3 <> 2) THEN 'm2' WHEN t IN ('SMALL', 'STANDARD') THEN 'm' WHEN t = 'LARGE' THEN '台' ELSE '個' END AS unit, 'site' AS location, 0.9::DOUBLE AS confidence
FROM m""",
    "rooms_to_items": """
WITH r AS (
  SELECT p_partkey, p_name, p_size AS s, CASE WHEN p_size % 4 <> 0 THEN p_size / 4.0::DOUBLE END AS w, CASE WHEN p_size % 4 <> 0 THEN p_size / 8.0::DOUBLE END AS d, CASE WHEN p_size % 5 <> 0 THEN 2.5::DOUBLE END AS h,
    CASE WHEN p_size % 7 = 0 THEN p_size * 1.5::DOUBLE END AS fa, CASE WHEN p_size % 11 = 0 THEN p_size * 2.25::DOUBLE END AS wa, CASE WHEN p_size % 2 = 0 THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END AS o,
    CASE WHEN p_size % 3 = 0 THEN p_size / 2.0::DOUBLE END AS ex FROM part
), a AS (
  SELECT *, coalesce(fa, w * d, 0.0::DOUBLE) AS floor_, coalesce(wa, CASE WHEN coalesce(ex, (w + d) * 2.0::DOUBLE) IS NOT NULL AND h IS NOT NULL THEN greatest(0.0::DOUBLE, coalesce(ex, (w + d) * 2.0::DOUBLE) * h - o) END, 0.0::DOUBLE) AS wall FROM r
), p AS (
  SELECT *, 0 AS pos, '壁' AS surface, round_even(wall, 2) AS area, CASE WHEN wa IS NULL AND ex IS NULL THEN 0.6::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM a WHERE s % 6 <> 1
  UNION ALL SELECT *, 1, '天井', round_even(floor_, 2), 0.95::DOUBLE FROM a WHERE s % 6 <> 0
  UNION ALL SELECT *, 2, '床', round_even(floor_, 2), 0.95::DOUBLE FROM a
)
SELECT p_partkey, pos, '断熱材(グラスウール)' AS name, CASE WHEN s % 2 = 1 THEN 't' || s END AS spec, area AS quantity, 'm2' AS unit, p_name || ' ' || surface AS location, confidence FROM p WHERE area > 0""",
    "risers_to_items": """
WITH r AS (
  SELECT o_orderkey, o_orderkey % 7 AS f, CASE WHEN o_orderkey % 5 <> 0 THEN 3.25::DOUBLE END AS h, greatest(1, o_orderkey % 3) AS n, CASE WHEN o_orderkey % 2 = 0 THEN 'DN50' END AS spec,
    CASE WHEN o_orderkey % 4 = 0 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS b, CASE WHEN o_orderkey % 6 = 0 THEN 0.5::DOUBLE ELSE 2.0::DOUBLE END AS fit, CASE WHEN o_orderkey % 8 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v,
    CASE WHEN o_orderkey % 9 = 0 THEN o_orderpriority ELSE 'R' END AS place FROM orders
), q AS (SELECT *, f * n AS span FROM r WHERE f > 0 AND h > 0),
p AS (
  SELECT o_orderkey, 0 AS pos, '配管' AS name, spec, round_even(h * span, 2) AS quantity, 'm' AS unit, place || ' 立管' AS location, 0.8::DOUBLE AS confidence FROM q
  UNION ALL SELECT o_orderkey, 1, '配管', spec, round_even(b * span, 2), 'm', place || ' 横引き', 0.75::DOUBLE FROM q
  UNION ALL SELECT o_orderkey, 2, '継手', spec, round_even(fit * span, 0), '個', place, 0.7::DOUBLE FROM q
  UNION ALL SELECT o_orderkey, 3, '仕切弁', spec, round_even(v * span, 0), '個', place, 0.75::DOUBLE FROM q
)
SELECT * FROM p WHERE quantity > 0""",
    "reconcile_table": _RECONCILE,
    "classify_fullwidth": f"""WITH {_CLASSIFIED} SELECT category, matched, unit, count(*) AS n, sum(quantity) AS quantity, count(DISTINCT name) AS names FROM classified GROUP BY category, matched, unit""",
    "specs_and_tolerances": f"""
WITH p AS (SELECT p_partkey, {_plain("p_name")} AS a, {_plain("split_part(p_name, ' ', 2) || ' ' || p_brand")} AS b, {_plain("split_part(p_name, ' ', -1)")} AS c, p_size::DOUBLE AS x, (p_size + p_partkey % 3)::DOUBLE AS y FROM part)
SELECT p_partkey, {_alike("a", "b")} AS brand_in, {_alike("a", "c")} AS word_in, abs(x - y) <= 0.05::DOUBLE * greatest(x, y) AS near_larger, abs(x - y) <= 0.05::DOUBLE * x AS near_truth FROM p""",
    "application_report": f"""WITH {_CLASSIFIED}, {_PIPE_LINES}, t AS (
SELECT ['# form（ドラフト）', '', '提出先: office', '', '## 申請者', '', '- 工事事業者: x（x）', '- 主任技術者: x', '', '## 工事場所', '', '- 物件名: x', '- 住所: x', '- 施主: x', '- 工事種別: new', '', '## 給水装置', '']
  || {_pipe_section("wet")} || ['', '合計延長: ' || (SELECT coalesce(sum(length), 0)::BIGINT FROM pipes WHERE system <> '排水') || ' m', '', '## 衛生器具', '']
  || coalesce(['| 器具 | 数量 |', '| --- | --- |'] || (SELECT list('| ' || name || ' | ' || quantity::BIGINT || ' |' ORDER BY name) FROM fixtures), ['（該当なし）'])
  || ['', '## 排水設備（参考）', ''] || {_pipe_section("NOT wet")} || ['', '## 提出書類', '', '- [ ] plan', '- [ ] list'] AS lines
) SELECT generate_subscripts(lines, 1) - 1 AS line, unnest(lines) AS text FROM t""",
    "accuracy_metrics": f"""WITH {_sides()},
s AS (SELECT count(*) FILTER (matched) AS matched, count(*) FILTER (ok) AS qty_match, (SELECT count(*) FROM items WHERE status = 'O') AS n_ai, (SELECT count(*) FROM items WHERE status = 'F') AS n_truth FROM m),
p AS (SELECT *, CASE WHEN n_ai > 0 THEN matched::DOUBLE / n_ai ELSE 0.0::DOUBLE END AS precision, CASE WHEN n_truth > 0 THEN matched::DOUBLE / n_truth ELSE 0.0::DOUBLE END AS recall, CASE WHEN matched > 0 THEN qty_match::DOUBLE / matched ELSE 0.0::DOUBLE END AS qty_rate FROM s)
SELECT *, CASE WHEN precision + recall > 0 THEN precision * recall * 2.0::DOUBLE / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM p""",
    "accuracy_by_category": f"""WITH {_sides()}
SELECT category, count(*) AS truth, count(*) FILTER (matched) AS matched, (count(*) FILTER (matched))::DOUBLE / count(*) AS recall,
  CASE WHEN count(*) FILTER (matched) > 0 THEN (count(*) FILTER (ok))::DOUBLE / count(*) FILTER (matched) ELSE 0.0::DOUBLE END AS qty_rate FROM m GROUP BY category""",
    "missing_items": f"WITH {_sides()} SELECT project_id, name, spec, location, quantity FROM truth WHERE key NOT IN (SELECT key FROM ai)",
    "extra_items": f"WITH {_sides()} SELECT project_id, name, spec, location, quantity FROM ai WHERE key NOT IN (SELECT key FROM truth)",
    "uncovered_codes": f"""WITH {_ITEMS}
SELECT DISTINCT location, spec AS code FROM items f WHERE status = 'F' AND NOT EXISTS (SELECT 1 FROM items o WHERE o.status = 'O' AND o.location = f.location AND lower(replace(o.spec, ' ', '')) = lower(replace(f.spec, ' ', '')))""",
    "feedback_stats": f"""WITH {_CORRECTIONS}
SELECT count(*) AS total, count(*) FILTER (before IS DISTINCT FROM after) AS quantity_fixes, count(DISTINCT coalesce(project, '-')) AS projects FROM c""",
    "training_pairs": f"WITH {_CORRECTIONS} SELECT project, ts, before, after FROM c",
    "diagnose_text": f"""
WITH jobs AS (SELECT * FROM {_values(_JOBS)} AS j(ord, job, lo, hi, warranty_months)), words AS (SELECT * FROM {_values(_WORDS)} AS w(ord, word)),
d AS (SELECT doc_id, lower(replace(coalesce(text, ''), ' ', '')) AS hay FROM documents),
s AS (SELECT doc_id, ord, count(*) AS score FROM d JOIN words ON contains(hay, word) GROUP BY doc_id, ord),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS rank FROM s)
SELECT doc_id, rank::INT AS rank, job, score::INT AS score, round_even(lo * 1.1::DOUBLE, 0)::BIGINT AS price_min, round_even(hi * 1.1::DOUBLE, 0)::BIGINT AS price_max, warranty_months FROM r JOIN jobs USING (ord) WHERE rank <= 3
UNION ALL SELECT doc_id, 1, '{R.FALLBACK[0]}', 0, round_even({R.FALLBACK[2]} * 1.1::DOUBLE, 0)::BIGINT, round_even({R.FALLBACK[3]} * 1.1::DOUBLE, 0)::BIGINT, 0 FROM d WHERE doc_id NOT IN (SELECT doc_id FROM s)""",
    "resolve_authority": f"""
WITH places AS (SELECT * FROM {_values(_PLACES)} AS p(ord, alias, form_name, authority)),
f AS (SELECT n_name, (SELECT min(ord) FROM places WHERE contains(n_name, alias) OR contains(alias, n_name)) AS ord FROM nation)
SELECT n_name, coalesce(p.form_name, '{R.DEFAULT_MUNICIPALITY[2]}') AS form_name, coalesce(p.authority, '{R.DEFAULT_MUNICIPALITY[3]}') AS authority FROM f LEFT JOIN (SELECT DISTINCT ord, form_name, authority FROM places) p USING (ord)""",
    "dictionary_validation": f"""
WITH e AS (SELECT * FROM {_values(_ENTRIES)} AS e(ord, canonical, category, unit)), a AS (SELECT * FROM {_values(_ALIASES)} AS a(ord, pos, canonical, alias)), n AS (SELECT * FROM e WHERE canonical <> '')
SELECT 'error' AS severity, 'V1' AS rule, NULL AS canonical, ord::VARCHAR AS detail FROM e WHERE canonical = ''
UNION ALL SELECT 'error', 'V2', canonical, '' FROM n WHERE category = '' UNION ALL SELECT 'error', 'V3', canonical, '' FROM n WHERE unit = ''
UNION ALL SELECT 'error', 'V4', canonical, '' FROM n WHERE EXISTS (SELECT 1 FROM n b WHERE b.canonical = n.canonical AND b.ord < n.ord)
UNION ALL SELECT 'warning', 'V5', canonical, category FROM n WHERE category NOT IN ('', '給水', '機器') UNION ALL SELECT 'warning', 'V6', canonical, unit FROM n WHERE unit NOT IN ('', 'm', '個')
UNION ALL SELECT 'error', 'V7', canonical, '' FROM a WHERE alias = '' UNION ALL SELECT 'warning', 'V8', canonical, alias FROM a WHERE alias = canonical
UNION ALL SELECT 'warning', 'V9', canonical, alias FROM a WHERE EXISTS (SELECT 1 FROM a b WHERE b.ord = a.ord AND b.alias = a.alias AND b.pos < a.pos)
UNION ALL SELECT 'warning', 'V10', canonical, alias FROM a WHERE alias <> '' AND length(alias) < 3
UNION ALL SELECT 'error', 'V11', canonical, alias FROM (SELECT *, lag(canonical) OVER (PARTITION BY alias ORDER BY ord, pos) AS before FROM a WHERE alias <> '') WHERE before <> canonical
UNION ALL SELECT 'error', 'V12', canonical, alias FROM a WHERE alias <> canonical AND alias IN (SELECT canonical FROM n)""",
    "text_layer_probe": r"""
SELECT source, sum(length(regexp_replace(coalesce(text, ''), '^[\s\x0B]+|[\s\x0B]+$', '', 'g')))::BIGINT AS n_chars, sum(length(regexp_replace(coalesce(text, ''), '^[\s\x0B]+|[\s\x0B]+$', '', 'g'))) >= 100000 AS has_text FROM documents GROUP BY source""",
    "tile_grid": """
WITH p AS (SELECT page_id, (page_id % 7 * 90 + 900)::DOUBLE / 3.0::DOUBLE AS w, 1200.0::DOUBLE / 3.0::DOUBLE AS h FROM pages)
SELECT page_id, r.i::INT AS row, c.i::INT AS col, c.i * w AS x0, r.i * h AS y0, (c.i + 1) * w AS x1, (r.i + 1) * h AS y1 FROM p, range(3) r(i), range(3) c(i)""",
    "bbox_points": """
WITH b AS (SELECT vec_id, label::INT AS page, list_transform(embedding[1:4], lambda x: (x * 100)::DOUBLE * (72.0::DOUBLE / 200.0::DOUBLE)) AS p FROM embeddings WHERE vec_id % 3 <> 0 AND label % 2 = 0)
SELECT vec_id, page, CASE WHEN vec_id % 4 = 0 THEN 0.95::DOUBLE ELSE 0.55::DOUBLE END AS blue, round(p[1], 4) AS box_x0, round(p[2], 4) AS box_y0, round(p[3], 4) AS box_x1, round(p[4], 4) AS box_y1,
  round(p[1], 4) AS label_x0, round(greatest(p[2] - 14.0::DOUBLE, 0.0::DOUBLE), 4) AS label_y0, round(p[1] + 180.0::DOUBLE, 4) AS label_x1, round(greatest(p[2] - 2.0::DOUBLE, 12.0::DOUBLE), 4) AS label_y1 FROM b""",
    "tenant_scope": """
SELECT o_orderkey, c_nationkey::BIGINT AS org_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 4 = 1)""",
    "replace_by_project": f"""WITH {_ITEMS}
SELECT project_id, status, count(*) AS n, sum(quantity) AS quantity FROM items WHERE (status = 'F' AND project_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)) OR (status = 'O' AND project_id % 3 = 0) GROUP BY project_id, status""",
    "upsert_projects": """
WITH o AS (SELECT o_custkey % 25 AS org_id, o_custkey % 40 AS slug, o_orderkey AS version, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('F', 'P')),
r AS (SELECT *, row_number() OVER (PARTITION BY org_id, slug ORDER BY CASE WHEN status = 'P' THEN 0 ELSE 1 END, version DESC) AS rn FROM o)
SELECT org_id, slug, version, status FROM r WHERE rn = 1""",
    "item_json": f"WITH {_CLASSIFIED} SELECT category, unit, count(*) AS n, sum(quantity) AS quantity FROM classified WHERE category <> 'その他' GROUP BY category, unit",
}
ORACLES["csv_source_measures"] = ORACLES["measures_to_items"]
ORACLES["json_source_rooms"] = ORACLES["rooms_to_items"].replace("SELECT p_partkey, p_name,", "SELECT p_partkey, p_partkey::VARCHAR AS p_name,")
ORACLES["corrections_log"] = ORACLES["feedback_stats"]
ORACLES["json_source_items"] = """
SELECT '"' || p_brand || '", \\ 径' AS spec, CASE WHEN p_size % 2 = 0 THEN 'm' END AS unit, count(*) AS n, sum(p_size)::DOUBLE AS quantity, max(ord) AS last
FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey // 1000 ORDER BY p_partkey) - 1 AS ord FROM part) GROUP BY 1, 2"""
ORACLES["quote_card_report"] = f"""
WITH d AS ({ORACLES["diagnose_text"]}), n AS (SELECT job, price_min, price_max, warranty_months, count(*) AS n FROM d GROUP BY ALL ORDER BY n DESC, job LIMIT 3),
t AS (SELECT ['# 透明見積カード', '', '## ご相談内容', '', '> （未入力）', '', '## 作業と料金めやす（税込）', '', '| 作業 | 料金めやす | 保証 |', '| --- | --- | --- |']
  || (SELECT list('| ' || job || ' | ¥' || format('{{:,}}', price_min) || '〜¥' || format('{{:,}}', price_max) || ' | ' || CASE WHEN warranty_months > 0 THEN warranty_months || 'ヶ月' ELSE '—' END || ' |' ORDER BY n DESC, job) FROM n)
  || ['', '## 作業記録', '', {_CARD_TAIL}] AS lines)
SELECT generate_subscripts(lines, 1) - 1 AS line, unnest(lines) AS text FROM t"""

_OFFERS = ", ".join(f"'| {name} | {months}ヶ月 | ¥{fee:,} |'" for name, months, fee in R.PLANS)
_NAME, _MONTHS, _FEE = R.PLANS[1]
ORACLES["maintenance_report"] = f"""WITH {_LEDGER},
y AS (SELECT label, installed_year, service_life, recommend_year, remaining, label || ' x' || count(*) AS name FROM ledger GROUP BY 1, 2, 3, 4, 5),
t AS (SELECT ['# 予防保全プラン提案 company', '', '布設 1992年 / 評価 {R.CURRENT_YEAR}年', '', '## 配管台帳', '', '| 名称 | 管種 | 仕様 | 布設年 | 耐用年数 | 更新推奨年 | 残存年 |', '| --- | --- | --- | --- | --- | --- | --- |']
  || (SELECT list('| ' || name || ' | ' || label || ' | — | ' || installed_year || ' | ' || service_life || ' | ' || recommend_year || ' | ' || remaining || CASE WHEN remaining <= 0 THEN '★' ELSE '' END || ' |' ORDER BY remaining, name) FROM y)
  || ['', (SELECT '更新時期: ' || name || CASE WHEN remaining <= 0 THEN ' （経過済み）' ELSE ' あと' || remaining || '年' END FROM y ORDER BY remaining, name LIMIT 1)]
  || ['', '## おすすめプラン: {_NAME}', '', '- {_MONTHS}ヶ月ごと', '- 月額 ¥{_FEE:,}（年額 ¥{_FEE * 12:,}）', '', '## 全プラン', '', '| プラン | 点検周期 | 月額 |', '| --- | --- | --- |', {_OFFERS}] AS lines)
SELECT generate_subscripts(lines, 1) - 1 AS line, unnest(lines) AS text FROM t"""


def _first_ten(label: str, side: str, other: str) -> str:
    rows = f"(SELECT * FROM {side} WHERE key NOT IN (SELECT key FROM {other}) ORDER BY key LIMIT 10)"
    return f"coalesce((SELECT ['{label}: ' || string_agg(name || ' (' || coalesce(nullif(spec, ''), '-') || ')', ', ' ORDER BY key)] FROM {rows} HAVING count(*) > 0), [])"


def _percent(x: str) -> str:
    return f"round({x} * 100)::INT || '%'"


ORACLES["accuracy_report"] = f"""WITH {_sides()},
one AS ({ORACLES["accuracy_metrics"]}), per AS ({ORACLES["accuracy_by_category"]}),
t AS (SELECT ['=== accuracy ===', 'items: found ' || n_ai || ', truth ' || n_truth || ', matched ' || matched, 'precision ' || {_percent("precision")} || ', recall ' || {_percent("recall")} || ', F1 ' || {_percent("f1")}, 'quantity: ' || qty_match || ' of ' || matched || ' (' || {_percent("qty_rate")} || ')']
  || (SELECT list('  ' || category || ': recall ' || {_percent("recall")} || ', quantity ' || {_percent("qty_rate")} || ' (' || matched || ' of ' || truth || ')' ORDER BY category) FROM per)
  || {_first_ten("missing", "truth", "ai")} || {_first_ten("extra", "ai", "truth")} AS lines FROM one)
SELECT generate_subscripts(lines, 1) - 1 AS line, unnest(lines) AS text FROM t"""
ORACLES["session_round_trip"] = f"WITH {_CLASSIFIED} SELECT category, source, unit, count(*) AS n, count(DISTINCT project_id) AS projects, sum(quantity) AS quantity, min(confidence) AS least, max(spec) AS spec FROM classified GROUP BY category, source, unit"
