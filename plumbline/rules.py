"""Rule tables as data. Larger ones (a full dictionary with aliases, long report texts) come from files: sources.rule_files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import schema

# They must equal the published rule set for equal results.
DEFAULT_CATEGORY = "その他"
STANDARD_CATEGORIES = ("給水", "給湯", "排水", "通気", "消火", "ガス", "冷媒", "冷温水", "ドレン", "弁類", "継手", "計装", "衛生器具", "機器", "ダクト", "保温", "支持金物", "はつり・復旧", "試験調整", "雑材", "断熱材", "気密防湿", "その他")
STANDARD_UNITS = ("m2", "m", "式", "箇所", "枚", "面", "台", "本", "個", "kg", "t")
MIN_PARTIAL = 3
SUPPLY, DRAINAGE = ("給水", "給湯"), ("排水", "通気")
LEDGER_CATEGORIES = ("機器", "衛生器具")
LEGEND_STOP = ("AND", "NOT", "THE", "FOR", "ALL", "NEW", "OLD", "TOP", "PER", "ROW", "COL", "NO")
SYMBOL_STOP = ("AND", "NOT", "THE", "FOR", "ALL", "NEW", "OLD", "TOP", "PER", "ROW", "COL")
KIND_UNITS = {"個数": "個", "台数": "台"}
DEFAULT_YEARS, DEFAULT_LIFE_LABEL = 20, "（標準）"

# Price, unit, material share, category, name.
PRICES = (
    (85000, "台", 0.70, "衛生器具", "大便器"), (45000, "台", 0.65, "衛生器具", "洗面器"), (150000, "台", 0.70, "機器", "給湯器"), (120000, "台", 0.65, "機器", "ポンプ"),
    (3500, "m", 0.45, "給水", None), (4200, "m", 0.50, "給湯", None), (3000, "m", 0.45, "排水", None), (2600, "m", 0.45, "通気", None), (5500, "m", 0.45, "消火", None),
    (4800, "m", 0.50, "ガス", None), (3800, "m", 0.55, "冷媒", None), (2400, "m", 0.45, "ドレン", None), (8000, "個", 0.60, "弁類", None), (1200, "個", 0.55, "継手", None),
    (60000, "台", 0.65, "衛生器具", None), (180000, "台", 0.65, "機器", None), (9000, "m2", 0.50, "ダクト", None), (1500, "m", 0.50, "保温", None), (1500, "個", 0.55, "支持金物", None),
    (6000, "箇所", 0.15, "はつり・復旧", None), (50000, "式", 0.05, "試験調整", None), (30000, "式", 0.60, "雑材", None), (2800, "m2", 0.55, "断熱材", None), (700, "m2", 0.45, "気密防湿", None),
    (4500, "m2", 0.55, "保温", "ラッキング"), (1800, "m", 0.50, "保温", "保温筒"), (4500, "m", 0.50, "冷温水", None), (12000, "個", 0.60, "計装", None), (50000, "式", 0.50, "その他", None),
)

# Keywords, years, label.
LIVES = (
    (("SGP", "白ガス管", "配管用炭素鋼", "鋼管"), 20, "鋼管(SGP)"), (("VLP", "ライニング鋼管", "塩ビライニング"), 25, "ライニング鋼管(VLP)"), (("HIVP", "VP", "塩ビ", "硬質塩化ビニル"), 25, "塩ビ管(VP/HIVP)"),
    (("CUP", "銅管", "銅"), 30, "銅管(CUP)"), (("SUS", "ステンレス"), 40, "ステンレス管(SUS)"), (("ポリ", "PE", "架橋ポリ", "ポリエチレン"), 30, "ポリエチレン管(PE)"),
    (("冷媒", "ペアコイル", "2分3分"), 15, "冷媒配管"), (("給湯器", "ポンプ", "給湯機"), 12, "給湯・ポンプ機器"),
)
PLANS = (("ライトプラン", 12, 3000), ("スタンダードプラン", 6, 6000), ("プレミアムプラン", 3, 12000))

# Job, keywords, least and greatest price before tax, months of warranty.
JOBS = (
    ("蛇口パッキン交換", ("蛇口", "カラン", "水漏れ", "ぽたぽた", "ポタポタ", "パッキン", "滴"), 3000, 8000, 6),
    ("単水栓・混合水栓 交換", ("水栓交換", "蛇口交換", "混合水栓", "シングルレバー", "カラン交換"), 15000, 40000, 12),
    ("トイレつまり除去（軽度）", ("トイレ", "つまり", "詰まり", "流れない", "便器", "水位"), 8000, 18000, 1),
    ("トイレつまり除去（重度・便器脱着）", ("便器脱着", "異物", "固形物", "高圧洗浄", "重度"), 20000, 45000, 1),
    ("排水つまり除去（台所・洗面）", ("排水", "つまり", "流れ", "シンク", "台所", "洗面", "排水溝", "逆流"), 8000, 22000, 1),
    ("トイレ止水不良（タンク内部品交換）", ("止まらない", "タンク", "ちょろちょろ", "ボールタップ", "フロート", "流れ続ける"), 8000, 20000, 6),
    ("給湯器 点検・交換", ("給湯器", "お湯", "出ない", "エラー", "着火", "給湯", "ガス給湯"), 80000, 250000, 24),
    ("ウォシュレット（温水洗浄便座）交換", ("ウォシュレット", "温水洗浄便座", "シャワートイレ", "便座"), 30000, 70000, 12),
    ("漏水調査・配管修理", ("漏水", "配管", "床下", "壁内", "にじみ", "水浸し", "水道メーター回る"), 15000, 50000, 6),
)
FALLBACK_JOB = ("現地調査・点検", (), 5000, 15000, 0)

# Name, aliases, form, authority.
MUNICIPALITIES = (
    ("東京都水道局", ("東京都", "都水道", "東水"), "給水装置工事申込書", "東京都水道局"),
    ("市原市", ("市原", "市原市水道部", "市原市上下水道"), "給水装置工事申込書（市原市）", "市原市水道部"),
    ("千葉県営水道", ("千葉広域水道企業団", "千葉県広域水道企業団", "千葉県企業局", "千葉県水道局", "千葉県営水道（企業局）", "千葉"), "給水装置工事申込書（千葉県営水道）", "千葉県企業局（千葉県営水道）"),
)
DEFAULT_MUNICIPALITY = ("", (), "給水装置工事申込書", "（提出先の水道事業者）")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, float(p), unit, ratio, None, category, name, None, "") for i, (p, unit, ratio, category, name) in enumerate(PRICES)], schema.PRICE)


def lives(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, list(k), y, label) for i, (k, y, label) in enumerate(LIVES)], schema.LIFE)


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, months, fee, "") for i, (n, months, fee) in enumerate(PLANS)], schema.PLAN)


def jobs(spark: SparkSession) -> DataFrame:
    """The fallback job has ord -1."""
    return spark.createDataFrame([(i, n, list(k), lo, hi, "", w) for i, (n, k, lo, hi, w) in [(-1, FALLBACK_JOB), *enumerate(JOBS)]], schema.JOB)


def municipalities(spark: SparkSession) -> DataFrame:
    """The default form has ord -1."""
    return spark.createDataFrame([(i, n, list(a), form, authority, "", [], "") for i, (n, a, form, authority) in [(-1, DEFAULT_MUNICIPALITY), *enumerate(MUNICIPALITIES)]], schema.MUNICIPALITY)
