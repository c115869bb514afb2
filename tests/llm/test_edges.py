"""Cases that each operator must bear: nulls, empty and long texts, ties, repeated rows, empty tables, extra
columns with clashing names; and texts whose words collide under linear hashes."""

import base64
import math
from collections import Counter, defaultdict

import numpy as np
import plain_urls
import pytest
from pyspark.sql import functions as F
from test_operators import prose

from tracelake.llm import _shared, bpe, decontaminate, lm_scoring, near_dedup, quality_rules, rule_classifier, substring_dedup, token_counts, url_filter, warc

P = pytest.importorskip("public_tokenizers")


def thue_morse(n: int, a: str, b: str) -> tuple[str, str]:
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.fixture(scope="module")
def colliding(spark):
    """Words of 1,024 and 2,048 letters that a polynomial modulo 2**64 can't tell apart, whatever its base."""
    rows = []
    for n in (1024, 2048):
        x, y = thue_morse(n, "a", "b")
        rows += [(len(rows) + i, " ".join([*prose(n, 60), w])) for i, w in enumerate((x, y, x))]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def test_collisions_in_word_operators(colliding):
    long = [r.text.split()[-1] for r in colliding.orderBy("doc_id").collect()]
    kept = {r.doc_id: r for r in substring_dedup.remove_repeats(colliding).collect()}
    assert [kept[i].kept for i in (1, 2)] == [long[1], ""] and kept[4].kept == long[4] and kept[5].n_removed == 61
    bench = colliding.sparkSession.createDataFrame([(1, long[0]), (2, long[3])], "item_id long, text string")
    assert {r.doc_id: r.item_ids for r in decontaminate.find_matches(colliding, bench).collect()} == {0: ["1"], 1: [], 2: ["1"], 3: ["2"], 4: [], 5: ["2"]}
    score = {r.doc_id: round(r.log_score, 6) for r in lm_scoring.score_documents(colliding).collect()}
    assert score[0] == score[2] != score[1] and score[3] == score[5] != score[4]
    sets = near_dedup.shingle_sets(*_shared.text_buffer(colliding.orderBy("doc_id").toArrow().column("text").combine_chunks()))
    assert np.array_equal(sets[0], sets[2]) and len(np.intersect1d(sets[0], sets[1])) == len(sets[0]) - 1


def test_collisions_in_tokenizers(colliding):
    import tiktoken
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    assert all(r.ids == library.encode_ordinary(r.text) for r in bpe.encode(colliding, path).collect())
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert all(r.n_tokens == len(own.encode(r.text, add_special_tokens=False).ids) for r in token_counts.count_tokens(colliding, P.path("byte_bpe_50k.json")).collect())


def test_bytes_decide_where_hashes_agree(monkeypatch):
    monkeypatch.setattr(_shared, "hash_spans", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    words = [b"a", b"bb", b"a", b"c" * 2000, b"", b"bb", b"c" * 1999 + b"d", b"c" * 2000, b"12345678", b"12345679"]
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    first, where = _shared.distinct_spans(np.frombuffer(b"".join(words), np.uint8), starts, ends)
    assert [words[i] for i in first[where]] == words and len(first) == len(set(words))


@pytest.mark.parametrize("window", [10, 17, 22])
def test_decontamination_by_window_and_block(spark, window):
    import random

    r = random.Random(window)
    items = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 60)))) for i in range(8)]
    docs = []
    for i in range(25):
        parts = [r.choice(items)[1].split() for _ in range(2)]
        docs.append((i, " ".join(w for p in parts for a in [r.randint(0, len(p))] for w in [*p[a : a + 40], "x"]), 99, True))
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words int, contaminated boolean")
    bench = spark.createDataFrame([*items, (3, items[0][1])], "item_id long, text string")
    want = {}
    for doc, text, *_ in docs:
        w, hit, ids = text.split(), set(), set()
        for item, body in [*items, (3, items[0][1])]:
            b = body.split()
            n = min(window, len(b))
            for j in range(len(b) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == b[j : j + n]:
                        hit |= set(range(i, i + n))
                        ids.add(str(item))
        want[doc] = len(hit), sorted(ids)
    for block in (1 << 20, 60):
        got = decontaminate.find_matches(df, bench, window=window, block_bytes=block).select("doc_id", decontaminate.hit_words().alias("h"), "item_ids").collect()
        assert {x.doc_id: (x.h, list(x.item_ids)) for x in got} == want
    clean = decontaminate.decontaminate(df, bench, window=window)
    assert clean.columns == df.columns and {tuple(x) for x in clean.collect()} == {d for d in docs if not want[d[0]][0]}


def test_warc_edges(spark):
    body = "z" * 120
    rows = [(1, "http://a.b/", body, "x", 5), (1, "http://a.b/", body, "y", 6), (2, None, body, "z", 7), (3, "http://long/", "w" * 300_000, None, 8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key string, payload_bytes int")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_and_read(df).collect())
    assert got == [(1, 120, "response", None), (1, 120, "response", None), (2, 120, "revisit", 1), (3, 300_000, "response", None)]


def test_scores_of_repeated_and_null_ids(spark):
    rows = [(1, "a b a b", "x"), (1, "a b", "y"), (None, "b c", "x"), (None, None, "x"), (2, "", "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, log_score string")
    seen = Counter(tuple(w[i : i + k]) for _, t, _ in rows for w in [(t or "").split()] for k in (1, 2, 3) for i in range(len(w) - k + 1))
    n = sum(v for g, v in seen.items() if len(g) == 1)

    def score(gram):
        if len(gram) == 1:
            return math.log(seen[gram] / n)
        return math.log(seen[gram] / seen[gram[:-1]]) if seen[gram] >= 2 else math.log(0.4) + score(gram[1:])

    want = defaultdict(float)
    for doc, t, _ in rows:
        w = (t or "").split()
        want[doc] += sum(score(tuple(w[max(0, i - 2) : i + 1])) for i in range(len(w)))
    got = {r.doc_id: r.log_score for r in lm_scoring.score_documents(df).collect()}
    assert got == pytest.approx(dict(want)) and lm_scoring.score_documents(df.limit(0)).count() == 0


def test_classifier_edges(spark):
    rows = [(i, " ".join(prose(i, 40 + i % 7) + ["|"] * (i % 2 * 9)), "clash") for i in range(60)] + [(None, "a b", "c"), (70, None, "c"), (71, "", "c"), (72, "long " * 90_000, "c"), (70, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(None, 1), (70, None)], "doc_id long, quality int")
    model = rule_classifier.learn(df, labels)
    got = rule_classifier.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id == 70}) == 1 and not [r for r in got if r.doc_id is None and r.held_out]
    assert rule_classifier.score(df.limit(0), model).count() == 0 and rule_classifier.score(df, rule_classifier.learn(df, labels.limit(0))).first().score == 0.5


def test_tokenizers_on_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7, 8), (1, "a b", 7, 8), (2, None, 7, 8)], "doc_id long, text string, n_tokens int, over_limit int")
    path, other = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
    assert [r.n_tokens for r in bpe.encode(df, path).orderBy("doc_id").collect()] == [r.n_tokens for r in token_counts.count_tokens(df, other).orderBy("doc_id").collect()] == [2, 2, 0]
    assert bpe.encode(df.limit(0), path).count() == token_counts.count_tokens(df.limit(0), other).count() == 0
    assert token_counts.splits_are_safe(other) and [r.over_limit for r in token_counts.count_tokens(df, other, limit=1).orderBy("doc_id").collect()] == [True, True, False]


def test_near_duplicates_edges(spark):
    long = " ".join(prose(80, 50_000))
    rows = [(5, long, "a"), (3, long + " tail", "b"), (7, "x y z", "c"), (7, "x y z", "d"), (8, "x y z", "e"), (None, "x y z", "f"), (9, None, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(0, 0, True), (3, 3, True), (5, 3, False), (7, 7, True), (7, 7, True), (8, 7, False), (9, 9, True)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0 and near_dedup.keep_one(df).columns == df.columns and near_dedup.keep_one(df).count() == 5


def test_large_drifting_group_at_its_real_size(spark):
    base, rows = prose(90, 80), []
    for k in range(150):  # each a step away from the one before, the ends far apart
        rows.append((k, " ".join([f"new{i}" if i < k // 3 else w for i, w in enumerate(base)])))
    sets = {d: set(zip(w, w[1:])) for d, t in rows for w in [t.split()]}
    root = {d: d for d in sets}
    for _ in range(6):
        for a in root:
            for b in root:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == root


def test_quality_rules_clash_and_long_text(spark):
    rows = [(1, "long text " * 60_000, 5, "x"), (2, " ".join(prose(1, 80)), 5, "y"), (2, " ".join(prose(1, 80)), 5, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string")
    got = sorted((r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality_rules.judge(df).collect())
    assert got == [(1, 120_000, True, False), (2, 80, False, True), (2, 80, False, True)]
    assert quality_rules.keep(df).columns == df.columns and quality_rules.keep(df).count() == 2


def plain_model(texts, order):
    counts = defaultdict(Counter)
    for t in texts:
        for i in range(len(t)):
            for k in range(order + 1):
                counts[k, tuple(t[max(0, i - k) : i]) if i >= k else ("start",) * (k - i) + tuple(t[:i])][t[i]] += 1

    def likelihood(t):
        total = 0.0
        for i in range(len(t)):
            p = 1 / 256
            for k in range(order + 1):
                own = counts.get((k, tuple(t[max(0, i - k) : i]) if i >= k else ("start",) * (k - i) + tuple(t[:i])))
                if own:
                    p = (own[t[i]] + len(own) * p) / (sum(own.values()) + len(own))
            total += math.log(p)
        return total

    return likelihood


def test_url_model_against_plain_counts():
    train = [f"http://a{i % 7}.example/{'x' * (i % 5)}".encode() for i in range(40)]
    plain, own = plain_model(train, url_filter.ORDER), plain_urls.Markov(train)
    texts = [b"http://a3.example/xx", b"", b"zq", "é/ü".encode(), train[0] * 3]
    assert own.log_likelihood(texts) == pytest.approx([plain(t) for t in texts])


def test_url_verdicts_of_the_model(spark):
    rows = [f"http://news{i}.net/de/artikel/{i}" for i in range(60)] + [f"http://casino{i}.com/en/win/{i}" for i in range(60)]
    rows += ["http://news7.info/artikel/70", "http://casino8.info/win/80", "http://news7.info/artikel/70", None, ""]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(rows)], "page_id long, url string, verdict string")
    got = [r.verdict for r in url_filter.judge(df).orderBy("page_id").collect()]
    assert got[:60] == ["allow"] * 60 and got[60:120] == ["block"] * 60 and got[120:123] == ["allow", "block", "allow"] and got[123] == got[124]
    assert url_filter.judge(df.limit(0)).count() == 0
    alone = url_filter.judge(df.filter("page_id < 60 or page_id = 121")).filter("page_id = 121").first()
    assert alone.verdict == "allow" and alone.score == 0


def test_url_models_learn_every_labelled_url(spark):
    good, bad = [f"a{i * i % 211}.net/de/{i}" for i in range(21_000)], [f"b{i % 97}.com/en/" + str(i**9) * 300 for i in range(300)]
    asked = ["a5.info/fr/77", "b7.info/fr/" + "9" * 50, "", "zé/ü", good[5], bad[7]]
    urls = [*good, *bad, *asked, *[asked[0]] * 1200, *[good[0]] * 1200]
    assert sum(map(len, bad)) > 1 << 20 and len(good) > 20_000
    df = spark.createDataFrame([(i, "http://" + u) for i, u in enumerate(urls)], "page_id long, url string").repartition(4)
    got = {r.page_id: r for r in url_filter.judge(df).filter(F.col("page_id") >= len(good) + len(bad)).collect()}
    models = [plain_urls.Markov([t.encode() for t in x]) for x in (good, bad)]
    want = plain_urls.ratio(*models, [u.encode() for u in asked])
    of = [got[len(good) + len(bad) + i] for i in range(len(asked))]
    assert [r.score for r in of] == pytest.approx(want) and [r.verdict for r in of[4:]] == ["allow", "block"]
    assert len(got) == len(asked) + 2400 and {(r.score, r.verdict) for i, r in got.items() if len(urls) - 2400 <= i < len(urls) - 1200} == {(of[0].score, of[0].verdict)}


def test_url_threshold_is_of_every_labelled_url(spark, monkeypatch):
    for name in ("SLICE_BYTES", "LEAST_BYTES", "PARTITION_BYTES"):
        monkeypatch.setattr(url_filter, name, 100)
    good = [f"a{i % 7}.net/de/{i}".encode() for i in range(25)] + [b"aaaaaaa"]
    bad = [f"b{i % 5}.com/en/{i * 7}".encode() for i in range(20)] + [b"a1.net/de/3x", b"y"]
    rows = [(t, c, 1) for texts, c in ((good, 1), (bad, 2), ([b"other/3"], 0)) for t in texts]
    urls = spark.createDataFrame(rows, "raw binary, class int, n long")
    scored = url_filter.score_distinct(urls, sum(len(r[0]) for r in rows))
    got = {bytes(r.raw): r for r in scored.collect()}
    models = [plain_urls.Markov(x) for x in (good, bad)]
    alone = lambda x, t: plain_urls.Markov([u for u in x if u != t])
    left = [plain_urls.ratio(alone(good, t), models[1], [t])[0] for t in good], [plain_urls.ratio(models[0], alone(bad, t), [t])[0] for t in bad]
    assert [got[t].left_out for t in good + bad] == pytest.approx([*left[0], *left[1]]) and len(got) == len(rows)
    assert [got[r[0]].score for r in rows] == pytest.approx(plain_urls.ratio(*models, [r[0] for r in rows]))
    assert url_filter.best_threshold(scored, len(good), len(bad)) == pytest.approx(plain_urls.calibrate(*map(np.array, left)))
    for good, bad in (([3.0, 4.0, 4.0, -1.0], [0.0, 1.0, 4.0]), ([0.0], [1.0]), ([2.5, 0.25], [0.25]), ([1.0], [1.0, 1.0]), ([0.1001, 0.1003], [0.1, 0.1002, 0.1004])):
        df = spark.createDataFrame([(x, 1) for x in good] + [(x, 2) for x in bad], "left_out double, class int")
        assert url_filter.best_threshold(df, len(good), len(bad)) == pytest.approx(plain_urls.calibrate(np.array(good), np.array(bad)))


def test_samples_stay_small(spark):
    df = spark.range(0, 50_000, 1, 64).select(F.xxhash64("id").alias("h"))
    near = _shared.by_least_hash(df, "h", 100)
    assert 100 <= near.count() < 1000 and [r.h for r in near.orderBy("h").limit(100).collect()] == [r.h for r in df.orderBy("h").limit(100).collect()]
    assert _shared.by_least_hash(df.limit(50), "h", 100).count() == 50 and _shared.by_least_hash(df.limit(0), "h", 5).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Far:
        master = "spark://somewhere"
        _jsc = spark.sparkContext._jsc
        getConf = spark.sparkContext.getConf

    class Session:
        sparkContext, conf = Far(), spark.conf

    if spark.sparkContext.getConf().get("spark.checkpoint.dir") is None and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(ValueError):
            _shared.shared_dir(Session())
    assert _shared.shared_dir(spark).startswith("file:///")


NAMES = ("spans", "raw", "text_", "__doc", "__version", "__spans", "__w", "__l", "__W", "__f_words", "__hot", "__score", "__raw", "__said", "__salt", "doc", "version", "first", "stop")


def test_names_of_extra_columns(spark):
    """Columns with any name that the operators use inside stay as they are."""
    import warnings

    warnings.simplefilter("ignore")
    names = [n for n in NAMES if n != "__W"]
    passage = " ".join(prose(31, 60))
    rows = [(i, passage if i < 2 else " ".join(prose(40 + i, 70)), f"http://a{i}.net/de/x", *(f"{n}{i}" for n in names)) for i in range(4)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "url string", *(f"`{n}` string" for n in names)]))
    model = rule_classifier.Model(0.0, ())
    for made in (substring_dedup.remove_repeats(df), quality_rules.judge(df), rule_classifier.score(df, model), url_filter.judge(df)):
        got = {r.doc_id: tuple(r[n] for n in names) for r in made.collect()}
        assert got == {i: tuple(f"{n}{i}" for n in names) for i in range(4)}
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df).collect()} == {0: 0, 1: 60, 2: 0, 3: 0}
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert substring_dedup.remove_repeats(decontaminate.find_matches(df, bench)).count() == 4  # which has spans of its own


def test_two_estimates_agree(spark):
    docs = spark.createDataFrame([(" ".join(prose(i, 20 + i * 5)) + "\n- a\n- a" * (i % 3),) for i in range(60)], "text string")
    first = quality_rules.estimate(docs)
    assert first == quality_rules.estimate(docs) and {x for x, *_ in first} == set(quality_rules.COSTS) and all(c > 0 for *_, c in first)


def test_repeats_are_found_by_the_index(spark, monkeypatch):
    """Without the index's ranges nothing is removed, copies of whole documents included."""
    passage = prose(60, 120)
    texts = [" ".join(passage), " ".join(passage), " ".join(prose(61, 30) + passage[20:90] + prose(62, 30)), " ".join(passage)]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df).collect()} == {0: 0, 1: 120, 2: 70, 3: 120}
    old = substring_dedup.search
    monkeypatch.setattr(substring_dedup, "search", lambda shards, window: old(shards, window).filter("kind = 1"))
    assert {r.n_removed for r in substring_dedup.remove_repeats(df).collect()} == {0}
