"""The numbered operators against brute force, on small tables with nulls, blanks, repeats and clashing columns."""

import gzip
import io
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plateworks.llm import batches, decontaminate, encode, langid, linear, neardup, packing, pipeline, quality, shared, sstable, topk, warc, wordpiece
from plateworks.llm.encode import vocabulary
from plateworks.llm.shared import shared_dir

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, score double"
LONG = " ".join(f"w{i % 997}x{i % 31}." for i in range(9000))
BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [None, "", "  \n\t ", "one", "one two three", "One TWO  three", "!!! ---", LONG, LONG, BASE, BASE + " more", BASE.replace("word30", "other"), "<|endoftext|>. it's é", " ".join(["the"] * 40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None, 0, 9, 0.5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "one two three", None, None, None, None, None)], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _components(rows):
    sets = {i: _shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_brute_force(docs, none):
    got = neardup.near_duplicates(docs).collect()
    want = _components(enumerate(TEXTS))
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert neardup.near_duplicates(none).count() == 0


def test_large_buckets_lose_no_link(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        words = [f"word{k}" for k in range(120)]
        for k in rng.integers(0, 120, rng.integers(0, 5)):
            words[k] = f"new{i}"
        rows.append((i, " ".join(words)))
    old, neardup.SMALL, neardup.BLOCK, neardup.HOT = (neardup.SMALL, neardup.BLOCK, neardup.HOT), 4, 16, 10
    try:
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        neardup.SMALL, neardup.BLOCK, neardup.HOT = old
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _components(rows)


def test_packing_holds_each_id_once(docs, none, tokenizer):
    rows = packing.pack(docs).collect()
    for i, text in enumerate(TEXTS):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        times = 2 if i == 4 else 1
        assert sum(r.length for r in mine) == times * len(ids) and {r.doc_tokens for r in mine} == {len(ids)}
        if times == 1:
            assert np.frombuffer(b"".join(r.tokens for r in mine), "<u4").tolist() == ids
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(none).count() == 0


def test_best_fit_takes_the_tightest_window():
    pieces = packing.best_fit(np.array([7, 6, 4, 3, 25, 0]), 10)
    assert sorted(p[:3] for p in pieces) == [(0, 0, 7), (1, 0, 6), (2, 0, 4), (3, 0, 3), (4, 0, 10), (4, 10, 10), (4, 20, 5), (5, 0, 0)]
    where = {p[0]: p[3] for p in pieces if p[0] < 4}
    assert where[3] == where[0] and where[2] == where[1]


def test_token_shards_round_trip_and_lookup(spark, docs, none, tokenizer):
    path = shared_dir(spark, "t")
    sstable.write_shards(docs, path)
    rows = sorted(sstable.read_shards(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, *sorted([*range(len(TEXTS)), 4])]
    at = 0
    for r in rows:
        want = tokenizer.encode(("one two three" if r.doc_id is None else TEXTS[r.doc_id]) or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, np.frombuffer(r.tokens, "<u4").tolist()) == (at, len(want), want)
        at += len(want)
    found = sstable.lookup(spark, path, [3, 4, 999]).collect()
    assert sorted(r.doc_id for r in found) == [3, 4, 4]
    assert sstable.lookup(spark, path, [-5]).count() == 0
    path = shared_dir(spark, "t")
    sstable.write_shards(none, path)
    assert sstable.read_shards(spark, path).count() == 0


def test_token_shards_part_repeated_ids_and_search_few_files(spark, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_TEXT_BYTES", 2000)
    rows = [(None if i % 3 else 7, f"text number {i} of many") for i in range(900)] + [(i, "own") for i in range(1000, 1100)]
    path = shared_dir(spark, "t")
    sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path)
    manifest = spark.read.parquet(f"{path}/_manifest").collect()
    assert len(manifest) > 5 and max(r.n_docs for r in manifest) < 400
    shards = {r.shard: sstable.Shard(bytes(r.content)) for r in sstable._files(spark, path).collect()}
    assert len(shards) == len(manifest)
    for m in manifest:
        ids = [i for i, _ in shards[m.shard].documents()]
        assert (m.low, m.high, m.n_docs, m.n_ids) == (sstable.key_of(ids[0]).hex(), sstable.key_of(ids[-1]).hex(), len(ids), shards[m.shard].n_ids)
    got = sorted(sstable.read_shards(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 600 + [7] * 300 + list(range(1000, 1100))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert sstable.lookup(spark, path, [7, 1005, 1]).count() == 301


def test_token_ids_that_do_not_fit_are_an_error():
    rows = [(1, np.array([70_000], np.uint32))]
    with pytest.raises(ValueError, match="70000"):
        list(sstable.shard_sections(iter(rows), 2))
    data = b"".join(x + b"\n" for x in sstable.shard_sections(iter(rows), 4))
    assert [t.tolist() for _, t in sstable.Shard(data).documents()] == [[70_000]]


def test_warc_round_trip(spark):
    big, equal = "é" * 90_000, "same payload " * 20
    rows = [(1, "u 1", big, 1), (2, None, None, 1), (3, "v", equal, 1), (4, "v", equal, 1), (5, "w", "short", 1), (6, "w", "short", 1), (7, "x", "a\r\n\r\nWARC/1.1\r\n" * 9, 1), (None, "n", equal, 1), (5, "w", "short", 1), (1, "u 1", big, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    path = shared_dir(spark, "w")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path).collect()
    key = lambda t: tuple(str(x) for x in t)
    first = {equal: 3, big: 1, rows[6][2]: 7}
    want = sorted([(i, "revisit" if len(h or "") >= 100 and first[h] != i else "response", first[h] if len(h or "") >= 100 and first[h] != i else None, len((h or "").encode())) for i, _, h, _ in rows], key=key)
    assert sorted([(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got], key=key) == want
    assert all(r.digest_ok for r in got)
    assert {r.payload.decode() for r in got if r.page_id == 1} == {big}


def test_a_damaged_payload_is_an_error(spark):
    rows = [(1, "aa", True), (2, "bb", None), (3, "cc", False)]
    records = spark.createDataFrame(rows, "page_id long, payload_digest string, digest_ok boolean")
    assert warc.whole(records.where("page_id = 1")).collect()[0].payload_digest == "aa"
    for page in (2, 3):
        with pytest.raises(Exception, match=f"page {page} differs"):
            warc.whole(records.where(f"page_id = {page}")).collect()


def test_warc_of_nothing_and_of_many_equal_pages(spark, monkeypatch):
    schema = "page_id long, url string, html string"
    path = shared_dir(spark, "w")
    warc.write_archives(spark.createDataFrame([], schema), path)
    assert warc.read_archives(spark, path).count() == 0
    monkeypatch.setattr(warc, "FILE_RUNS", 1)
    rows = [(7, "u", "x" * 70_000)] * 40 + [(None, None, "y" * 70_000)] * 40
    path = shared_dir(spark, "w")
    warc.write_archives(spark.createDataFrame(rows, schema).repartition(3), path)
    got = warc.read_archives(spark, path)
    assert {(r.page_id, r.record_type, r.payload_bytes): r["count"] for r in got.groupBy("page_id", "record_type", "payload_bytes").count().collect()} == {(7, "response", 70_000): 40, (None, "response", 70_000): 40}
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    names = files.select("content").rdd.flatMap(lambda r: [h["warc-record-id"] for h, _ in warc.read_records(gzip.GzipFile(fileobj=io.BytesIO(r.content)))]).collect()
    assert len(names) == len(set(names)) == 160 and files.count() > 5


def test_large_classes_are_joined_as_small_ones(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "abc"[k % 3] if k % 7 else None) for k in range(60)], "id long, key string")
    classes = spark.createDataFrame([("a", 99, "big"), ("b", 2, "small")], "key string, n long, name string")
    want = sorted(map(repr, shared.with_class(rows, classes, "key").select("id", "key", "n", "name").collect()))
    monkeypatch.setattr(shared, "FEW_ROWS", 1)
    got = shared.with_class(rows, classes, "key", large=50)
    assert sorted(map(repr, got.select("id", "key", "n", "name").collect())) == want and len(want) == 60


def test_warc_finds_missing_segments():
    assert warc.reassemble([2, 1], [5, None], [b"lo", b"hel"]) == [b"hello"]
    for numbers, totals, blocks in (([1, 3], [None, 5], [b"hel", b"lo"]), ([1, 2], [None, 9], [b"hel", b"lo"]), ([1], [None], [b"hel"])):
        with pytest.raises(ValueError):
            warc.reassemble(numbers, totals, blocks)
    assert warc.unchunked(warc.chunked(b"x" * 20_000)) == b"x" * 20_000


def test_token_counts_equal_greedy_matching(docs, none):
    pieces = wordpiece.vocabulary()
    known, longest = set(pieces), max(map(len, pieces))

    def brute(word):
        word, at, n = wordpiece.MARK + word, 0, 0
        while at < len(word):
            k = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in known), None)
            if k is None:
                return None
            at, n = at + k, n + 1
        return n

    got = {r.doc_id: r for r in wordpiece.count_tokens(docs, pieces).collect()}
    for i, text in enumerate(TEXTS):
        each = [brute(w) for w in (text or "").split()]
        assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (len(each), sum(1 if n is None else n for n in each), each.count(None))
    assert wordpiece.count_tokens(none, pieces).count() == 0
    a = wordpiece.Automaton(["▁a", "▁ab", "b", "bc", "c"])
    words = ["abc", "abbc", "ad", "acc", "b", "a" * 3 + "b" * 200, "a" + "bc" * 100]
    assert a.count_all(words).tolist() == [a.count(w) for w in words] == [2, 2, -1, 3, -1, -1, 101]


@pytest.mark.parametrize("small", [False, True])
def test_top_k_equals_sql(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 16), ("QUERY_BLOCK", 2), ("RUN", 2), ("SPAN", 2)):
            monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 8)) * rng.uniform(0.1, 3, (400, 1)))]
    rows[7] = (7, rows[50][1])
    rows[9] = (9, None)
    rows[11] = (11, [float("nan")] * 8)
    rows[13] = (13, [None] * 8)
    rows += [(i, rows[60][1]) for i in range(400, 420)] + [rows[60]]
    rows += [(k, rows[j][1]) for k, j in ((100, 7), (100, 8), (33, 21), (33, 22), (33, 22), (150, 150))]  # rows of one id, some of them asking
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("norm2", F.lit("x"))
    got = topk.top_k(df, df.where("vec_id % 50 = 0")).toPandas()
    embeddings = df.drop("norm2").toArrow()  # noqa: F841
    want = duckdb.sql(topk.OP1_SQL).df()
    key = ["query_id", "rank"]
    assert got.sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True).astype(got.dtypes.to_dict()))
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_takes_every_row_of_an_id_and_refuses_large_components(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [5.0, 5.0]), (1, [1.0, 0.0]), (2, [2.0, 2.0]), (1, [5.0, 5.0])], "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1, 655_360), (2, 1, 655_360), (3, 2, 262_144), (4, 1, 65_536)]
    for large in (1e8, 1e17):
        with pytest.raises(ValueError, match="too large"):
            more = df.union(spark.createDataFrame([(9, [large, 1.0])], df.schema))
            topk.top_k(more, more.where("vec_id % 9 = 0"))
    wide = df.withColumn("embedding", F.transform("embedding", lambda x: (x * 1e6).cast("float")))
    assert topk.top_k(wide, wide.where("vec_id = 0")).where("rank = 1").first().score == 655_360 * 10**12


def test_decontamination_finds_changed_numbers(spark, none):
    item = "Anna has 12 apples and gives 5 apples to each of her 12 friends in the town before the long rain comes down"
    changed = item.replace("12", "31").replace("5", "8")
    torn = item.replace("12 apples", "31 apples").replace("12 friends", "44 friends")
    rows = [(1, "x. " + item + ". y"), (2, changed), (3, torn), (4, None), (5, "  "), (6, "quite other words of no interest at all to anyone here or there"), (None, item), (1, "x. " + item + ". y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(3))
    bench = spark.createDataFrame([(7, item), (8, None), (None, item), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.changed_slots for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 7): 0, (2, 7): 2}
    assert decontaminate.contaminated(none, bench).count() == 0 == decontaminate.contaminated(docs, bench.limit(0)).count()


def test_decontamination_takes_lists_and_fractions_number_by_number(spark):
    item = "The seats 1,2,3 and 10,20,30 weigh 3.5 kg and 1.2.3 in all when the tables are set for the guests of honour"
    other = item.replace("1,2,3", "41,52,63").replace("10,20,30", "7,8,9").replace("3.5", "12.25").replace("1.2.3", "40.50.60")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item), (2, other), (3, " ".join(f"{w} {i}.{i}" for i, w in enumerate(["apple"] * 40_000)) + " " + item), (4, "word " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_windows, r.item_windows, r.changed_slots) for r in decontaminate.contaminated(docs, bench).collect()}
    n = got[1][1]
    # The windows with fewer than four literal words are met by their raw words alone.
    assert set(got) == {1, 2, 3} and got[1] == got[3] == (n, n, 0) and got[2] == (11, n, 3)
    words = {r.doc_id: r.words for r in decontaminate._both_words(docs.where("doc_id < 3"), "doc_id", "text").select("doc_id", "words").collect()}
    assert words[1] == words[2] and words[1][2:9] == ["0", "0", "0", "and", "0", "0", "0"]
    raws = decontaminate._both_words(docs.where("doc_id = 1"), "doc_id", "text").first().raws
    assert "3#5" in raws and "35" not in raws


def test_decontamination_finds_short_items_in_long_documents(spark):
    filler = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, f"{filler}. What is the capital of France? {filler}"), (2, filler), (3, "What is the capital of France?"), (4, f"{filler} blue cheese"), (5, "blue"), (6, f"{filler}. What is the capital city of France? {filler}")]
    rows += [(7, f"{filler}\r\n - Blue  cheese!\n{filler}"), (8, "blue cheese"), (9, "oh yes it was a fine day for all of us here"), (10, "Yes."), (11, "oh, yes"), (12, f"{filler} 7 times 8 makes {filler}"), (13, f"{filler} 6 times 8 makes {filler}"), (14, "yes\nyes"), (15, None)]
    items = [(1, "What is the capital of France?"), (2, "Blue cheese"), (3, "yes"), (4, "7 times 8 makes"), (5, " ?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    # Items of under four words are found alone in a line or document only.
    assert {r[:4] for r in got} == {(1, 1, 1, 1), (3, 1, 1, 1), (7, 2, 1, 1), (8, 2, 1, 1), (10, 3, 1, 1), (12, 4, 1, 1), (14, 3, 1, 1)}
    documents, benchmark = docs.toArrow(), bench.toArrow()  # noqa: F841
    want = duckdb.sql(decontaminate.OP9_SQL).df()
    assert got == set(want[["doc_id", "item_id", "n_windows", "item_windows", "changed_slots"]].itertuples(index=False, name=None))


def test_decontamination_counts_verbatim_passages_beside_torn_slots(spark):
    item = "Anna has 12 apples and gives 5 apples to each of her 12 friends in the town before the long rain comes down and the river near the old mill begins to rise over its banks once more"
    cut = item.split(" in the town")[0]
    rows = [(1, item.replace("12 apples", "31 apples")), (2, cut.replace("12 apples", "31 apples")), (3, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_windows, r.item_windows, r.changed_slots) for r in decontaminate.contaminated(docs, bench).collect()}
    # Row 1 equals the item from the fourth word on, row 2 only over 11 words.
    n = len(item.split()) - 7
    assert got == {1: (n - 3, n, 1), 3: (n, n, 0)}


def test_decontamination_finds_verbatim_items_of_few_literal_words(spark):
    sums = "17 23 45 67 12 99 31 and 45 times 23 17 88 90 41 52 63"
    items = [(1, sums), (2, "What is 17 times 23"), (3, "Question: Anna Berta Carla Dora Emil Fritz Gustav Hans Ida Jakob"), (4, "@ % 0")]
    rows = [(1, f"So we read. {sums} and so on."), (2, "They asked: What is 17 times 23 in all, and left."), (3, items[2][1] + " came."), (4, sums.replace("17", "18").replace("45", "46")), (5, "They asked: What is 18 times 23 in all."), (6, "Question: Olga Paul Quirin Rosa Stefan Toni Ute Vera Willi Xaver came.")]
    docs, bench = (spark.createDataFrame(r, f"{i} long, text string") for r, i in ((rows, "doc_id"), (items, "item_id")))
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1): (10, 10), (2, 2): (1, 1), (3, 3): (4, 4)}


def test_language_models(spark, docs, none):
    full = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = langid.learn(full)
    rows = langid.score(full, models, keep=("lang",)).where(langid.fold("doc_id", 5) == 0).select((F.col("best") == F.col("lang")).cast("int").alias("y"), F.col("accepted").cast("int").alias("a")).toPandas()
    assert rows.y.mean() > 0.95 and rows.a.mean() > 0.95
    got = {r.doc_id: r for r in langid.score(docs, models).collect()}
    assert all(got[i].best == "und" and got[i].score == 0 and not got[i].accepted for i in (0, 1, 2, 6))
    assert langid.score(none, models).count() == 0
    assert langid.learn(none).count() == 0 and {r.best for r in langid.score(docs, None).collect()} == {"und"}
    for m in langid.load(models):  # probabilities after one context add up to one
        grams, contexts = m.grams[0], m.contexts[0]
        assert abs(grams[1].sum() + contexts[1][0] - 1) < 1e-9


def test_quality_learns_and_scores_everything(spark, docs, none):
    d = "/root/testdata/sf0.01"
    full, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality(full, labels)
    assert got.count() == full.count()
    m = got.join(labels, "doc_id").where("held_out").toPandas()
    assert ((m.predicted == m.quality).mean()) > 0.9
    small = quality.quality(docs, labels.limit(0)).collect()
    assert len(small) == docs.count() and {r.score for r in small} == {0.5}
    assert quality.quality(none, labels).count() == 0


def test_features_are_unit_vectors():
    import pyarrow as pa

    at, x, bounds = linear.features(pa.array(["a b a", None, "c"]), quality.OPTIONS)
    assert bounds.tolist()[1] == bounds.tolist()[2]
    assert abs((x[: bounds[1]] ** 2).sum() - 1) < 1e-9


def test_pipeline_keeps_columns_and_unrelated_rows(spark):
    from plateworks.llm import pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.withColumn("score", F.lit("s")).unionByName(docs.limit(3).withColumn("score", F.lit("s")))
    for name, stage in c.STAGES[:-1]:
        before = extra.count()
        extra = c.save(stage(spark, extra, SF), name)
        assert extra.columns == [*docs.columns, "score"] and 0 < extra.count() <= before
    assert extra.count() == extra.select("doc_id").distinct().count()
    rows = c.STAGES[-1][1](spark, extra, SF)
    assert rows.select("doc_id").distinct().count() == extra.count()
    assert rows.select(F.crc32("tokens")).schema[0].dataType == T.LongType() and zlib.crc32(b"") == 0


def test_pipeline_keeps_different_texts_of_one_id(spark):
    from plateworks.llm import pipeline as c

    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    a, b, other = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(1, a), (1, b), (1, a), (2, other), (2, None), (3, leak), (3, "quite " + b[::-1]), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", F.lit("x"))
    once = c.save(c.near_duplicates(spark, docs, SF), "once")
    key = lambda t: tuple(str(x) for x in t)
    assert once.columns == docs.columns and sorted([(r.doc_id, r.text) for r in once.collect()], key=key) == sorted(set(rows), key=key)
    left = c.decontamination(spark, once, SF)
    assert left.columns == docs.columns and sorted([(r.doc_id, r.text) for r in left.collect()], key=key) == sorted(set(rows) - {(3, leak)}, key=key)


@pytest.mark.parametrize("most", [7, 2**62 + 5, 2**63 - 1])
def test_pipeline_numbers_further_texts_of_an_id_apart_from_all_ids(spark, most):
    rows = [(5, "a"), (5, "b"), (5, "b"), (5, None), (5, ""), (6, "b"), (most, "c"), (None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pipeline._vertices(docs).collect()
    of = {}
    for r in got:
        of.setdefault((r._row.doc_id, r.text), set()).add(r.vertex)
    assert len(got) == len(rows) and all(len(v) == 1 for v in of.values())
    known = [next(iter(v)) for (i, _), v in of.items() if i is not None]
    assert len(set(known)) == len(known) == 6 and 5 in known and of[None, "b"] == {None}
    ids = {5, 6, most}
    assert all(v in ids or v > most or v < 5 for v in known)


def test_near_duplicates_without_broadcasts(spark, docs, monkeypatch):
    key = lambda r: (str(r.doc_id), r.n_shingles)
    more = docs.unionByName(spark.createDataFrame([(None, BASE, None, None, None, None, None)] * 3, DOC))
    want = sorted(neardup.near_duplicates(more).collect(), key=key)
    monkeypatch.setattr(shared, "FEW_ROWS", 0)
    got = sorted(neardup.near_duplicates(more).collect(), key=key)
    assert got == want and {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(None, True)}


def test_a_shards_texts_are_encoded_in_small_slices():
    import tracemalloc

    words = [chr(97 + k % 26) * (k % 5 + 1) for k in range(400_000)]
    rows = pa.RecordBatch.from_pydict({"text": [" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)] * 5})
    memory = encode.Memory(sstable.REMEMBERED)
    list(encode.encode(rows.column(0).slice(0, 1), encode.vocabulary(), 1, memory))
    tracemalloc.start()
    n = sum(len(ids) for part in batches.slices(iter([rows]), "text", sstable.ENCODE_BYTES) for ids in encode.encode(part.column(0), encode.vocabulary(), 1, memory))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= len(words) * 5 and peak < 32 << 20, peak


def test_words_alike_are_trimmed_and_lower_cased_unless_they_may_hold_a_sign():
    words = ["Ab \t", "\x0bX\x0c\r\n", "<|EndOfText|> ", "A<B", "É", " Q", "", " "]
    assert encode._alike(pa.array(words, pa.large_string())) == ["ab", "x", "<|EndOfText|>", "A<B", "É", " Q", "", ""]
