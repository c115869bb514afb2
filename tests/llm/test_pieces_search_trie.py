"""SentencePiece codec against its library; lexical search and the prefix trie against brute force; their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import prose

from tracelake.llm import lexical_search, piece_bpe, prefix_trie, queries

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.01"
MODEL = P.path("piece_bpe_32k.model")


# SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_of_odd_texts(library):
    r = random.Random(4)
    letters = "ab  ▁\t\n012é漢字ß🙂\x00<>s'd.,⁇"
    texts = ["", " ", "  ", "▁", "<s>", "<0x41>", "<unk> </s>", "a" * 5000, " " * 3000, "﻿x", "é", "🙂" * 700, "Ω" * 9]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    ids, places, bounds = piece_bpe.codec(MODEL).encode(pa.array([*texts, None]))
    for k, (text, want) in enumerate(zip(texts, library.encode(texts))):
        own = ids[bounds[k] : bounds[k + 1]].tolist()
        assert own == want and piece_bpe.codec(MODEL).decode(own) == library.decode(want), text
        at = [*places[bounds[k] : bounds[k + 1]].tolist(), len(text)]
        assert at == sorted(at) and (not own or at[0] == 0)
        for i, (a, b) in enumerate(zip(at, at[1:])):  # a token's characters are those between its place and the next one's
            piece = library.id_to_piece(own[i])
            assert piece.startswith("<0x") or piece.replace("▁", " ").removeprefix(" " if i == 0 else "") == text[a:b].replace("▁", " "), text
    assert bounds[-1] == bounds[-2]


def test_decoding_any_ids(library):
    r = random.Random(5)
    for _ in range(3000):
        ids = [r.choice((r.randrange(32_000), r.randrange(3, 259), 0, 1, 2, library.piece_to_id("▁"))) for _ in range(r.randint(0, 9))]
        assert piece_bpe.codec(MODEL).decode(ids) == library.decode(ids), ids


def test_agenda_takes_the_best_pair_first():
    """A plain search for the best adjacent pair, over the whole text at once."""
    r, model = random.Random(6), piece_bpe.codec(MODEL).model
    for _ in range(300):
        text = " " + "".join(r.choice("the in on and er  ing.") for _ in range(r.randint(1, 30)))
        parts = list(text)
        while (best := min(((-model.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in model.scores), default=None)) is not None:
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
        assert piece_bpe.merge(text, model) == [model.ids[p] for p in parts]


def test_pieces_over_whole_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert piece_bpe.disagreements(docs, MODEL).count() == 0
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = queries.op11_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_and_tables(spark, library):
    rows = [(1, None, 5), (2, "", 5), (3, "one two", 5), (3, "one two", 5), (None, "x" * 50_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long").withColumnRenamed("ids", "n_tokens").withColumn("own", F.lit(1))
    done = piece_bpe.encode(docs, MODEL)
    assert done.columns == ["doc_id", "text", "own", "n_tokens", "ids", "offsets"]
    assert Counter((r.doc_id, tuple(r.ids)) for r in done.collect()) == Counter((i, tuple(library.encode(t or ""))) for i, t, _ in rows)
    back = piece_bpe.decode(done, MODEL).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert piece_bpe.encode(docs.limit(0), MODEL).count() == piece_bpe.disagreements(docs, MODEL).count() == 0


def test_other_models_are_rejected(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    for change in ("type", "user", "spaces"):
        told = proto.ModelProto()
        told.ParseFromString(open(MODEL, "rb").read())
        if change == "type":
            told.trainer_spec.model_type = 1
        elif change == "user":
            told.pieces[300].type = 4
        else:
            told.normalizer_spec.remove_extra_whitespaces = True
        (tmp_path / change).write_bytes(told.SerializeToString())
        with pytest.raises(ValueError):
            piece_bpe.Model(str(tmp_path / change))


# Lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    counts = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n, total, df = sum(s > 0 for s in sizes), sum(sizes), Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), c, size in zip(docs, counts, sizes):
            if size:
                m = 25 + 75 * size * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
                if score > 0:
                    scores.append((-score, doc is not None, doc or 0))
        out += [(item, rank, doc if known else None, -score) for rank, (score, known, doc) in enumerate(sorted(scores)[:k], 1)]
    return out


def searched(docs, items, k=10, **options):
    return sorted(map(repr, (tuple(r) for r in lexical_search.search(docs, items, k, **options).select("item_id", "rank", "doc_id", "score").collect())))


@pytest.mark.parametrize("options", [{}, {"item_bytes": 200, "doc_bytes": 500}, {"doc_bytes": 300, "held": 8}])
def test_search_against_brute_force(spark, options):
    r = random.Random(8)
    words = [*prose(2, 60), "É", "日本", "x1"]
    text = lambda n: " ".join(r.choice(words[: r.choice((5, 63))]).upper() if r.random() < 0.2 else r.choice(words) + r.choice(",.-_ ") for _ in range(n))
    docs = [(i, text(r.randint(0, 40))) for i in range(200)]
    docs += [(i, docs[7][1]) for i in range(300, 330)] + [(5, docs[5][1]), (None, docs[7][1]), (None, None), (400, None), (401, "..."), (402, words[0] * 4000), (403, text(3000))]
    items = [(i, text(r.randint(1, 30))) for i in range(25)] + [(25, docs[7][1]), (25, docs[7][1]), (26, None), (27, "- -"), (None, words[3]), (28, "nowhere")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit(1), "score": F.lit("s"), "block": F.lit(0)}).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({"rank": F.lit(1), "doc_id": F.lit("s")}).repartition(2)
    for k in (1, 10):
        assert searched(d, b, k, **options) == sorted(map(repr, plain_search(docs, items, k)))


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("i", "b c"), ("j", None)], "item_id string, text string")
    assert searched(docs.limit(0), items) == searched(docs, items.limit(0)) == searched(docs.withColumn("text", F.lit("?")), items) == []
    # A term in every document has weight floor(1000 ln(4 / 3)) here.
    assert searched(docs, items) == [repr(("i", 1, 1, 287 * (1_000_000_000 // (1000 + 8 * 100))))]


# Prefix trie


def plain_trie(rows, graft=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, mark, role, text))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9 if graft else 0
        built[c] = own.get(c - math.fmod(c, 5), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(key[:-1] for key in members if key)
    leaves, saved = Counter(), Counter()
    for key, convs in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not kids[key]
            saved[key[:d]] += (len(convs) - 1) * len(key[-1][1].encode()) if key else 0
    return sorted(
        (min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), kids[key], leaves[key], saved[key], hashlib.sha256(",".join(map(str, sorted(c for c in convs if len(built[c]) == len(key)))).encode()).hexdigest())
        for key, convs in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def tries(spark, rows, graft=True):
    turns = prefix_trie.numbered(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("place", "hash", "size", "n", "class", "length")}))
    return sorted(tuple(r) for r in prefix_trie.trie(*(prefix_trie.grafted if graft else prefix_trie.whole)(turns)).select(*COLUMNS).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, seed):
    r = random.Random(seed)
    say = lambda: (r.choice((None, "", "user", "bot")), r.choice((None, "", "a", "b", "é")))
    rows = [(c, t, *say()) for c in r.sample(range(-20, 200), 120) for t in range(r.randint(1, 8))]
    rows += [(c, t, "user", "same") for c in range(500, 560) for t in range(4)]  # one very common conversation
    rows += [(7, None, "x", None), (7, None, "x", None), (7, 3, None, None), (8, 1, "a", "b"), (8, 1, "ab", ""), (None, 0, "user", "a"), (-3, -9, "user", "early"), (9_000_001, 100, "u", "far"), (9_000_001, 20_000, "u", "off")]
    assert tries(spark, rows) == plain_trie(rows) and tries(spark, rows, False) == plain_trie(rows, False)


def test_trie_of_long_conversations(spark):
    """Prefixes shared over several rounds, conversations that end at their edges, and one that goes on alone."""
    n = prefix_trie.BLOCK
    rows = [(c, t, "user", f"t{t}" if t < shared else f"{c}.{t}") for c, size, shared in ((0, 3 * n, 3 * n), (1, 3 * n, 3 * n), (2, 2 * n, 2 * n), (3, 2 * n + 1, 2 * n), (4, 6 * n, n + 3), (5, n, n), (6, 20, 0)) for t in range(size)]
    assert tries(spark, rows, False) == plain_trie(rows, False)


def test_small_tries(spark, monkeypatch):
    assert tries(spark, [(None, 1, "a", "b")]) == []
    alone = [(4, 0, "a", "b"), (4, 1, "c", "dd")]
    assert tries(spark, alone, False) == plain_trie(alone, False) and len(plain_trie(alone, False)) == 3
    turnless = [(1, 0, "a", "b")]  # crc32("1") % 9 is 6, and there is no conversation 0
    assert tries(spark, turnless) == plain_trie(turnless) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr(prefix_trie, "SLOT", 2)
    many = [(c, t, "a", "b") for c in range(40) for t in range(5)]
    assert tries(spark, many, False) == plain_trie(many, False)


def test_turns_of_nodes(spark):
    rows = spark.createDataFrame([(c, t, "user", f"{c * (t > 1)}-{t}") for c in range(4) for t in range(3)], SCHEMA)
    nodes = prefix_trie.last_turns(prefix_trie.trie(*prefix_trie.whole(prefix_trie.numbered(rows))), rows).collect()
    assert sorted((r.depth, r.conv_id, r.text, r.n_convs) for r in nodes if r.depth) == [(1, 0, "0-0", 4), (2, 0, "0-1", 4), *((3, c, f"{c}-2", 1) for c in range(4))]
    assert [(r.role, r.text) for r in nodes if not r.depth] == [(None, None)]


@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_prefix_trie"])
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = queries.QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    want = con.sql(queries.SQL[name])
    assert sorted(want.columns) == columns
    assert sorted(map(str, want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())) == sorted(str(tuple(r)) for r in ours.select(*columns).collect())
