"""Operators on hand-made rows: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import base64
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import bpe, decontaminate, fm_index, lm_scoring, near_dedup, quality_rules, queries, rule_classifier, substring_dedup, token_counts, url_filter, warc

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, n_words long, words string"


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    passage, long = prose(1, 70), prose(2, 60_000)
    rows = [
        (0, " ".join(prose(3, 30) + passage + prose(4, 30))), (1, " ".join(prose(5, 40) + passage + prose(6, 9))), (2, " ".join(prose(7, 80))), (3, " ".join(prose(7, 80))),
        (4, " ".join(prose(7, 79) + ["other"])), (5, ""), (6, None), (7, " \n\t "), (None, " ".join(passage)), (None, None), (8, " ".join(long)), (9, " ".join(long[100:400])),
        (10, "word"), (11, "WORD"), (12, "x" * 20_000), (13, "é漢 <|endoftext|> don't  \n 12"), (13, "é漢 <|endoftext|> don't  \n 12"), (14, "a b " * 300),
    ]
    return spark.createDataFrame([(a, b, 7, "clash") for a, b in rows], SCHEMA).cache()


def texts(df):
    return [(r.doc_id, (r.text or "").encode()) for r in df.collect()]


def test_fm_index_against_brute_force():
    r = np.random.default_rng(3)
    for _ in range(25):
        depth = int(r.integers(2, 9))
        sizes, own_sizes = r.integers(1, 30, 12), r.integers(1, 30, 9)
        words, own = (r.integers(1, 4, n.sum()).astype(np.uint64) for n in (sizes, own_sizes))
        owner = r.integers(0, 50, len(sizes))
        found, least = fm_index.FMIndex(words, sizes, owner, depth).matching_statistics(own, own_sizes)
        held = {}
        for part, o in zip(np.split(words, np.cumsum(sizes)[:-1]), owner):
            part = tuple(part.tolist())
            for i in range(len(part)):
                for j in range(i + 1, min(len(part), i + depth) + 1):
                    held[part[i:j]] = min(held.get(part[i:j], 99), o)
        at = 0
        for part in np.split(own, np.cumsum(own_sizes)[:-1]):
            part = tuple(part.tolist())
            for i in range(len(part)):
                k = max((j for j in range(min(depth, len(part) - i) + 1) if j == 0 or part[i : i + j] in held))
                assert (found[at], least[at]) == (k, held[part[i : i + k]] if k == depth else -1)
                at += 1


@pytest.mark.parametrize("hot", [200, 1])
def test_substring_dedup(docs, hot):
    first, want = {}, []
    for doc, text in sorted(texts(docs), key=lambda x: (x[0] is None, x[0] or 0)):
        w = text.split()
        gone = [False] * len(w)
        for i in range(len(w) - 49 if doc is not None else 0):
            if first.setdefault(tuple(w[i : i + 50]), doc) < doc:
                gone[i : i + 50] = [True] * 50
        want.append((doc, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    got = substring_dedup.remove_repeats(docs, hot=hot)
    assert "words" in got.columns
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select("doc_id", "n_words", "n_removed", "kept").collect())
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [200, 1])
def test_substring_dedup_of_one_id_with_two_texts(spark, hot):
    passage, clean, head = prose(30, 70), prose(31, 120), prose(32, 15)
    rows = [(1, passage), (2, head + passage + prose(33, 20)), (2, clean), (3, clean[20:100] + prose(34, 10)), (4, prose(35, 30) + clean[:60])]
    want = [(1, " ".join(passage)), (2, " ".join(head + rows[1][1][85:])), (2, " ".join(clean)), (3, " ".join(rows[3][1][80:])), (4, " ".join(rows[4][1][:30]))]
    got = substring_dedup.remove_repeats(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string"), hot=hot)
    assert sorted((r.doc_id, r.kept) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("block", [8 << 20, 1])
def test_decontamination(spark, docs, block):
    items = [(1, " ".join(prose(1, 70)[5:30])), (2, "don t"), (3, None), (None, "word"), (3, "zzz zzz"), (1, " ".join(prose(7, 12)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: [x.group() for x in __import__("re").finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())]
    want = []
    for doc, text in texts(docs):
        w, hit, ids = split(text), set(), set()
        for item, body in items:
            b = split((body or "").encode())
            n = min(10, len(b))
            for j in range(len(b) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == b[j : j + n]:
                        hit |= set(range(i, i + n))
                        ids.add("" if item is None else str(item))
        want.append((doc, len(w), len(hit), sorted(ids)))
    got = decontaminate.find_matches(docs, bench, block_bytes=block).select("doc_id", "n_words", decontaminate.hit_words(), "item_ids")
    assert sorted(map(str, want)) == sorted(str((r[0], r[1], r[2], list(r[3]))) for r in got.collect())
    assert not decontaminate.find_matches(docs, bench.limit(0)).filter("contaminated").count()


def test_warc(spark):
    body = "y" * 150
    rows = [(1, "http://a.b/x", body), (2, None, body), (3, "http://a.b/x", "short"), (4, "q\r\nz", "short"), (5, "", None), (None, "http://a.b/x", body), (6, "http://c/é", "é" * 60)]
    got = {r[0]: tuple(r)[1:] for r in warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 7 and got[2][2:] == ("revisit", 1) and got[None][2:] == ("revisit", 1)
    assert got[1] == (150, hashlib.sha256(body.encode()).hexdigest(), "response", None)
    assert got[5] == (0, hashlib.sha256(b"").hexdigest(), "response", None) and got[3][2] == got[4][2] == "response" and got[6][0] == 120
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_look_up_by_url(spark):
    # One URL fills many blocks and index files, another two blocks; some are asked for twice, some are not there.
    urls = ["http://hot.org/"] * 4000 + ["http://b.hot.org/x"] * 700 + [f"http://s{i % 90}.net/{i % 3}" for i in range(300)] + [None] * 5
    pages = spark.createDataFrame([(i, u, f"text {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    folder = warc.scratch(spark, "warc")
    captures = warc.write_archives(warc.plan(pages.repartition(3)), folder)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = warc.build_index(captures, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.filter("first <= 'org,hot)/' and last >= 'org,hot)/'").count() > 1
    asked = ["http://hot.org/", "http://HOT.org/", "http://b.hot.org/x", "http://s7.net/1", "http://s7.net/9", "a.com", None]
    got = warc.look_up(spark.createDataFrame([(u,) for u in asked], "url string"), index, folder).collect()
    assert sorted(r.page_id for r in got) == [i for i, u in enumerate(urls) if u in asked]
    assert all(r.payload_digest == hashlib.sha256(f"text {r.page_id}".encode()).hexdigest() for r in got)
    assert {r.key for r in got} == {"org,hot)/", "org,hot,b)/x", "net,s7)/1", "-"}
    assert warc.read_records(captures, index, folder).count() == len(urls)


def test_scores_do_not_depend_on_slices(docs):
    own = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    a, b = ({r.doc_id: (r.n_words, round(r.log_score, 6)) for r in lm_scoring.score_documents(own, order=3, slice_bytes=n).collect()} for n in (1 << 24, 3000))
    assert a == b and a[5] == a[6] == (0, 0.0)


def test_registered_scores_see_beyond_pairs(spark, tmp_path):
    rows = ["x m y"] * 3 + ["p m q"] * 3 + ["x m q", "p m y"]  # every word and pair of the spliced texts is as frequent as those of the others
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.log_score for r in queries.op4_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[0] == got[5] and got[6] == got[7] < got[0] - 0.5


def test_registered_scores_against_counts(docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(doc, text.split()) for doc, text in texts(docs)]
    seen = Counter(tuple(w[i : i + k]) for _, w in rows for k in (1, 2, 3) for i in range(len(w) - k + 1))
    n = sum(len(w) for _, w in rows)

    def score(gram):
        if len(gram) == 1:
            return math.log(seen[gram] / n)
        return math.log(seen[gram] / seen[gram[:-1]]) if seen[gram] >= 2 else math.log(0.4) + score(gram[1:])

    want = defaultdict(lambda: [0, 0.0])
    for doc, w in rows:
        want[doc][0] += len(w)
        want[doc][1] += sum(score(tuple(w[max(0, i - 2) : i + 1])) for i in range(len(w)))
    got = queries.op4_lm_scoring(docs.sparkSession, str(tmp_path)).collect()
    assert len(got) == len(want)
    for r in got:
        words, total = want[r.doc_id]
        assert r.n_words == words and r.log_score == pytest.approx(total, abs=1e-3)
        assert r.mean_log_score == pytest.approx(total / words, abs=1e-5) if words else r.mean_log_score is None


def test_classifier_learns_from_its_rows_only(spark):
    r = random.Random(1)
    rows = [(i, " ".join(prose(i, r.randint(20, 90)) + (["|"] * 30 if i % 4 == 0 else [])), int(i % 4 != 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    held = rule_classifier.held_out(F.col("doc_id"))
    wrong = df.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    models = [rule_classifier.learn(df.drop("quality"), x.select("doc_id", "quality")) for x in (df, wrong)]
    assert models[0] == models[1]
    scored = rule_classifier.score(df, models[0]).filter("held_out").collect()
    assert scored and np.mean([x.predicted == x.quality for x in scored]) > 0.97
    assert rule_classifier.learn(df.drop("quality"), df.limit(0)).predict(np.zeros((1, 8)))[0] == 0.5


def test_bpe_equals_the_library(docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    encoded = bpe.encode(docs, path)
    for r in encoded.collect():
        assert r.ids == library.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids) == len(r.offsets)
    assert all((r.text or "") == r.back for r in bpe.decode(encoded, path, into="back").collect())
    alphabet = "aZés'tremvld'  \n\t  　 1٣²!?#é漢😀\x1c\x85'’"
    own, random_ = bpe.Codec(path), random.Random(4)
    for _ in range(300):
        t = "".join(random_.choice(alphabet) for _ in range(40))
        raw = np.frombuffer(t.encode(), np.uint8)
        assert own.encode(raw, np.array([0, len(raw)]))[0].tolist() == library.encode_ordinary(t)


@pytest.mark.parametrize("group", [64, 1])
def test_near_duplicates(spark, group):
    r, rows = random.Random(5), [(100, None), (101, ""), (102, "one"), (103, "ONE"), (104, "one two"), (None, "one")]
    for family in range(4):
        base = prose(50 + family, 60)
        for k in range(12):
            copy = list(base)
            for _ in range(r.randint(0, 7)):
                copy[r.randrange(60)] = "z" + str(r.randrange(1000))
            rows.append((family * 12 + k, " ".join(copy)))
    sets = {}
    for doc, text in rows:
        w = (text or "").lower().split()
        sets[doc] = set(zip(w, w[1:])) if len(w) > 1 else set(w)
    root = {d: d for d in sets if d is not None}
    for _ in range(len(root)):
        for a in root:
            for b in root:
                i = len(sets[a] & sets[b])
                if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                    root[a] = root[b] = min(root[a], root[b])
    got = {x.doc_id: x for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), group=group).collect()}
    assert {d: got[d].component_id for d in root} == root and got[None].component_id is None and got[None].kept
    assert all(got[d].n_shingles == len(sets[d]) and (d is None or got[d].kept == (d == root[d])) for d in sets)


def test_near_duplicates_by_shingles_of_five(spark):
    import corpus_pipeline

    base = prose(60, 200)
    other = [f"new{i}" if i % 25 == 12 else w for i, w in enumerate(base)]
    rows = [(0, " ".join(base)), (1, " ".join(other)), (2, " ".join([*base[:-1], "end"])), (3, "a b c"), (4, "A b  c"), (5, "a b"), (6, "a b c d e"), (7, None), (8, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = lambda x: sorted(r.doc_id for r in x.collect())
    assert ids(near_dedup.keep_one(df)) == [0, 3, 5, 6, 7, 8] and ids(near_dedup.keep_one(df, shingle=5)) == [0, 1, 3, 5, 6, 7, 8]
    assert ids(corpus_pipeline.near_duplicates(spark, df, "")) == [0, 1, 3, 5, 6, 7, 8]
    assert [r.n_shingles for r in near_dedup.near_duplicates(df, shingle=5).orderBy("doc_id").collect()][3:] == [1, 1, 1, 1, 0, 1]


def test_token_counts_equal_the_library(docs):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(docs, path).collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode())


def test_quality_rules(docs):
    found = quality_rules.estimate(docs.filter("doc_id is not null"))
    share = {name: hits for name, hits, _ in found}
    assert len(found) == 7 and share["too_short"] > 0.3 and share["digits"] == 0 and all(cost > 0 for *_, cost in found)
    none = docs.limit(0)
    assert quality_rules.keep(none).count() == quality_rules.judge(none).count() == 0
    assert len({r.kept for r in quality_rules.judge(docs).filter("doc_id = 13").collect()}) == 1 and quality_rules.keep(docs).columns == docs.columns
    assert [x for x, *_ in quality_rules.estimate(none)] == sorted(share)
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert (got[14].n_words, got[14].n_repeat_words, got[14].base_failed) == (600, 600, True)
    assert got[6].n_words == 0 and not got[6].kept and got[2].kept and got[8].n_words == 60_000
    assert {r.doc_id for r in quality_rules.keep(docs).collect()} == {d for d, r in got.items() if r.kept and d is not None} | ({None} if quality_rules.keep(docs).filter("doc_id is null").count() else set())


def test_url_filter(spark):
    urls = ["http://A.com/en/x", "https://example.com/en/7?q", "http://x.net/de/a#b", "http://example.net/de/81", "ftp://org/es/", "no scheme", None, "http://com/fr", "http://nocom/en/", "http://h"]
    got = [tuple(r) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert got[0] == ("a.com", "/en/x", "com/en/", "block") and got[1][2:] == ("example.com/en/7", "allow") and got[3][2] == "example.net/de/8"
    assert got[2] == ("x.net", "/de/a", "net/de/", "allow") and got[4][2:] == ("org/es/", "block") and got[5][:3] == got[6][:3] == ("", "", None) and got[8][2] is None
