"""The pipeline on a small corpus equals a brute-force version of its five stages."""

import base64
import hashlib
import random
import re

import pytest

import corpus_pipeline

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


def changed(words: list[str], step: int) -> list[str]:
    return [f"new{i}" if i % step == step // 2 else w for i, w in enumerate(words)]


PASSAGE, LONG = prose(1, 70), prose(2, 200)
BENCHMARK = [(1, " ".join(PASSAGE[20:34])), (2, " ".join(prose(3, 6))), (3, None)]
ROWS = [
    (0, "\n".join(prose(4, 120))), (1, " ".join(changed(prose(4, 120), 100))),  # near-duplicates
    (2, " ".join(prose(5, 40))), (3, "again and " * 300), (4, " ".join(["##"] * 20 + prose(6, 60))), (5, " ".join(prose(6, 60))),  # 5 would go for the sake of 4
    (6, " ".join(prose(7, 90) + PASSAGE)),  # contaminated, but 7 and 8 lose the passage because of it
    (7, " ".join(prose(8, 60) + PASSAGE + prose(9, 30))), (8, " ".join(PASSAGE[3:68])),
    (9, " ".join(prose(10, 60) + [w.upper() for w in prose(3, 6)] + prose(11, 20))),
    (10, " ".join(LONG)), (11, " ".join(changed(LONG, 25))),  # alike in pairs of words, not in fives
    (12, "- one line of some words\n" * 30), (13, None), (None, " ".join(prose(12, 80))), (14, " 1234567890" * 60), (15, "  kept  as\tit is " + " ".join(prose(13, 70))),
]


def good(text: str) -> bool:
    w = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    if len(w) < 50:
        return False
    threes = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + o for i, t in enumerate(threes) if threes.count(t) > 1 for o in range(3)}
    chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text)
    bullets, digits = sum(bool(re.match("[-*\u2022]", x.lstrip(" "))) for x in lines), sum(c in "0123456789" for c in text)
    return not (
        100 * len(covered) > 50 * len(w) or 10 * symbols > len(w) or 2 * chars < 5 * len(w) or chars > 15 * len(w)
        or 10 * (len(lines) - len(set(lines))) > 4 * len(lines) or 3 * digits > len(text) or 10 * bullets > 9 * len(lines)
    )


def one_of_each(docs: dict) -> dict:
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in docs.items() if d is not None for w in [t.lower().split()]}
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {d: t for d, t in docs.items() if d is None or root[d] == d}


def cut_out(docs: dict) -> dict:
    first, out = {}, {}
    for doc in sorted(docs, key=lambda d: (d is None, d)):
        w = docs[doc].split()
        gone = [False] * len(w)
        for i in range(len(w) - 49 if doc is not None else 0):
            if first.setdefault(tuple(w[i : i + 50]), doc) < doc:
                gone[i : i + 50] = [True] * 50
        left = [x for x, g in zip(w, gone) if not g]
        if left:
            out[doc] = " ".join(left) if any(gone) else docs[doc]
    return out


def clean(docs: dict) -> dict:
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())
    bad = set()
    for _, item in BENCHMARK:
        b = split(item or "")
        n = min(10, len(b))
        bad |= {tuple(b[j : j + n]) for j in range(len(b) - n + 1) if n}
    sizes = {len(x) for x in bad}
    return {d: t for d, t in docs.items() for w in [split(t)] if not any(tuple(w[i : i + n]) in bad for n in sizes for i in range(len(w)))}


def test_pipeline_against_brute_force(spark, tmp_path):
    import tiktoken

    rows = [(d, t, "en", "web", len(t or "")) for d, t in ROWS]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {d: t for d, t in ROWS if good(t or "")}
    single = one_of_each(kept)
    short = cut_out(single)
    want = clean(short)
    # Each stage has something to do.
    assert {0, 1, 5, 6, 7, 8, 9, 10, 11, 15, None} == set(kept) and set(kept) - set(single) == {1} and set(single) - set(short) == {8}
    assert short[7] != single[7] and set(short) - set(want) == {6, 9}
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for d, r in got.items():
        assert list(r.ids) == library.encode_ordinary(want[d]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(want[d].encode()).hexdigest()
    passages = corpus_pipeline.repeated_passages(spark, spark.createDataFrame([x for x in rows if x[0] in single and (x[0], x[1]) in single.items()], SCHEMA), str(tmp_path))
    assert {r.doc_id: (r.text, r.n_chars, r.lang) for r in passages.collect()} == {d: (t, len(t), "en") for d, t in short.items()}
