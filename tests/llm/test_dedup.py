"""The deduplicating operators against brute force on a small table."""

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from plumbline.llm import common, exact_dedup, line_dedup, ngram_join, suffix_dedup, suffix_sort

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_exact(docs, rows, odd, empty):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i))
    want = {}
    for norm, own in groups.items():
        keep = min(own)[1]
        want |= {i: (keep, len(own), i == keep, sha(norm)) for _, i in own}
    got = exact_dedup.exact_dedup(docs, capacity=8).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == want
    assert len({r["bucket"] for r in got}) > 4  # the directory has doubled
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if w[2]}
    assert {(r["doc_id"], r["kept"]) for r in exact_dedup.exact_dedup(odd).collect()} == {(None, False), (1, True), (2, True)}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_directory_doubles_only_full_buckets(spark):
    df = spark.range(64).selectExpr("id << 40 as h").union(spark.range(2).selectExpr("9223372036854775807 - id as h"))
    base, starts = exact_dedup.directory(df, "h", 16)
    got = exact_dedup._with_bucket(df, "h", base, starts).groupBy("slot", "part").count().collect()
    assert max(r["count"] for r in got) <= 16 and sum(r["count"] for r in got) == 66 and list(starts) == [0]


def test_buckets_of_one_key(spark):
    """Neighbouring keys split to the last bit, and a directory of the smallest capacity stays small."""
    df = spark.createDataFrame([(6,), (7,), (1 << 62,)], "h long")
    base, starts = exact_dedup.directory(df, "h", 1)
    assert sum(map(len, starts.values())) < 64
    assert exact_dedup._with_bucket(df, "h", base, starts).select("slot", "part").distinct().count() == 3


def test_chains_of_colliding_keys(docs, rows, monkeypatch):
    """With three keys for all texts, owners tell texts apart by their bytes."""
    want = {tuple(r)[:5] for r in exact_dedup.exact_dedup(docs).collect()}
    monkeypatch.setattr(exact_dedup, "key_of", lambda norm: F.pmod(F.length(norm), F.lit(3)).cast("long"))
    got = exact_dedup.exact_dedup(docs, capacity=1).collect()
    assert {tuple(r)[:5] for r in got} == want and max(r["chain"] for r in got) > 5 and len({r["bucket"] for r in got}) == 3


def test_columns_may_clash(spark, empty):
    odd = spark.createDataFrame([(1, "a b", 5, 6, 7), (None, "a  b", 5, 6, 7), (2, "c", 5, 6, 7)], "doc_id long, text string, _bad_id long, _keep_id long, _id long")
    assert {r["doc_id"] for r in exact_dedup.keep_one(odd).collect()} == {1, 2}
    assert ngram_join.keep_one(odd).columns == odd.columns and ngram_join.keep_one(empty).count() == exact_dedup.keep_one(empty).count() == 0


def test_lines(docs, rows, odd, empty):
    keys = defaultdict(set)
    lines = {i: (t or "").split("\n") for i, t, *_ in rows}
    key = {x: lower(x.strip(" \t\n\x0b\x0c\r")) for own in lines.values() for x in own}
    for i, own in lines.items():
        for x in own:
            if len(key[x]) >= 40:
                keys[key[x]].add(i)
    want = {}
    for i, own in lines.items():
        stay = [x for x in own if len(keys.get(key[x], ())) < 5 or max(keys[key[x]]) == i]
        want[i] = (len(own), len(own) - len(stay), sha("\n".join(stay)), "\n".join(stay))
    got = line_dedup.line_dedup(docs, batches=3).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and sum(w[1] for w in want.values()) > 10
    assert {(r["doc_id"], r["n_lines"]) for r in line_dedup.line_dedup(odd).collect()} == {(None, 1), (1, 1), (2, 1)}
    assert line_dedup.line_dedup(empty).count() == 0


def test_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for b in range(3):
        runs.add(spark.createDataFrame([(b, 1, 1), (b, b + 10, 0)], line_dedup.LINES), b)
    assert [len(x) for x in runs.levels] == [1, 1]
    assert {(r["h1"], r["n_docs"], r["max_doc"], r["first_batch"]) for r in runs.lookup().collect()} == {(1, 3, 2, 0), (10, 1, 0, 0), (11, 1, 1, 1), (12, 1, 2, 2)}
    # The anti join decides what a run holds: a key is in one run only, and what repeats is an update of it.
    held = [r["h1"] for run in runs._runs() for r in run.collect()]
    assert sorted(held) == [1, 10, 11, 12]
    assert sorted((r["h1"], r["n_docs"]) for u in runs.updates for r in u.collect()) == [(1, 1), (1, 1)]
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_a_lookup_moves_no_run(spark):
    runs = line_dedup.LineRuns(spark, fanout=4)
    for b in range(3):
        runs.add(spark.createDataFrame([(b, 1, 1), (b, b + 10, 0)], line_dedup.LINES), b)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = runs.joined(spark.createDataFrame([(9, 1, 1)], line_dedup.LINES), 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == 1  # the batch's own sums
    runs.close()


def test_ngram_classes(docs, rows, odd, empty):
    sets = {}
    for i, t, *_ in rows:
        w = SPACE.split(lower(t or "").strip(" \t\n\x0b\x0c\r"))
        w = [x for x in w if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    comp = {i: i for i in ids}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    want = {i: (len(sets[i]), find(i)) for i in ids}
    got = ngram_join.ngram_classes(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({w[1] for w in want.values()}) < len(ids) - 20
    kept = ngram_join.keep_one(docs)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in ids if want[i][1] == i}
    assert {tuple(r)[:3] for r in ngram_join.ngram_classes(odd).collect()} == {(None, 4, None), (1, 4, 1), (2, 0, 2)}
    assert ngram_join.ngram_classes(empty).count() == 0


def test_heavy_tokens_travel_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY", 3)
    df = spark.createDataFrame([(i, "a b c d e f g h i j " * 3 + (f"x{i} y{i} z{i} u{i}" if i % 2 else "")) for i in range(40)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_classes(df).collect()}
    assert len(set(got.values())) == 21 and got[0] == got[2] == 0


def test_hot_keys_are_cut(spark, monkeypatch):
    """Rows of a key that holds most of them are dealt over pieces; each meets its right row once."""
    left = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(600)] + [(None, -1), (-5, -2)], "k long, v long")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(600)] + [(None, "n")], "k long, t string")
    want = sorted((7, i, "r7") if i % 3 else (i, i, f"r{i}") for i in range(600))
    for piece, parts in ((65_536, 1000), (10, 1000), (10, 4), (1, 1000)):
        monkeypatch.setattr(common, "PIECE", piece)
        monkeypatch.setattr(common, "HOT_PARTS", parts)
        got = common.salted_join(left, right, "k", left.select("k"), 602, F.xxhash64("v"))
        assert got.columns == ["k", "v", "t"] and sorted(map(tuple, got.collect())) == want


def test_pairs_with_one_lead(spark, monkeypatch):
    """Near copies of one text, with its pairs in pieces and its tokens' buckets both broadcast and shuffled."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        words = list(base) if i % 3 else [f"x{rng.randrange(10**6)}" for _ in range(80)]
        if i % 3:
            words[rng.randrange(80)] = f"y{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(common, "PIECE", 2)
    monkeypatch.setattr(common, "HOT_PARTS", 4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_classes(df).collect()}
    assert got == {i: 1 if i % 3 else i for i, _ in rows}


def without_repeats(texts):
    """(bytes, removed, spans, digest, what stays) of each text, in order of ids, by brute force."""
    seen, want = set(), {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        want[i] = (len(b), len(b) - len(kept), spans, sha(kept), kept)
    return want


def test_suffixes(docs, rows, odd, empty):
    want = without_repeats([(i, t) for i, t, *_ in rows])
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert {r["doc_id"]: (*tuple(r)[1:5], bytes(r["kept"])) for r in got} == want
    assert {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(odd).collect()} == {(None, 0), (1, 0), (2, 0)}
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffixes_sorted_over_tasks(docs, rows, monkeypatch):
    """All contexts through the distributed sort, in small blocks and ranges."""
    monkeypatch.setattr(suffix_dedup, "SPLIT", 1)
    monkeypatch.setattr(suffix_sort, "BLOCK", 20_000)
    monkeypatch.setattr(suffix_sort, "RANGE_ROWS", 2_000)
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert {r["doc_id"]: (*tuple(r)[1:5], bytes(r["kept"])) for r in got} == without_repeats([(i, t) for i, t, *_ in rows])


def test_an_anchor_in_thousands_of_contexts(spark, monkeypatch):
    """A passage in 5,000 texts with other text around it, which some of them share."""
    rng = random.Random(8)
    passage = "the same passage of a licence or footer, in every text of them"
    rows = [(i, f"{rng.choice('abcdefgh') * rng.randrange(30, 60)}{rng.randrange(40)} {passage} {rng.randrange(60)}{rng.choice('xyzuv') * rng.randrange(20, 70)}") for i in range(5000)]
    called = []
    monkeypatch.setattr(suffix_dedup, "later_windows", lambda *a: called.append(1) or suffix_sort.later_windows(*a))
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = without_repeats(rows)
    assert {r["doc_id"]: (*tuple(r)[1:5], bytes(r["kept"])) for r in got} == want and called and sum(w[1] for w in want.values()) > 1000
