"""Piece encoding against the library, alignment and whitening against plain versions, odd inputs."""

import hashlib
import random
from array import array
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from inkveil.llm import alignment, pieces, queries, whitening
from pyspark.sql import functions as F

PIECES, BYTES = (public_tokenizers.path(p) for p in (queries.PIECES, queries.BYTES))
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
TEXTS = [
    None, "", " ", "one two  three", "one two  three", "a▁b", "tab\tand\nline\r\n", "ﬁ İß 漢字 😀 ──竹", "<s> <|endoftext|> <0x41>",
    "x" * 3000, " " * 500, " ".join(f"w{i}" for i in range(3000)), "ends with blank ", "\x00 null", "don't stop, it's 12,5%",
]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcdeθΣσİß'strem 01.,\n\té😀́漢▁<|>─", max_size=80))
def test_pieces_like_the_library(text):
    table = pieces.piece_table(PIECES)
    ids = table.encode(text)
    assert list(array("I", ids)) == LIBRARY.encode(text)
    assert table.decode(ids) == LIBRARY.decode(LIBRARY.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 262)), max_size=12), st.integers(1, 5))
def test_decoding_any_ids_in_steps(ids, step):
    table = pieces.piece_table(PIECES)
    machine = pieces.PieceText(table)
    parts = [machine.feed(array("I", ids[i : i + step])) for i in range(0, len(ids), step)]
    assert "".join(parts) + machine.end() == LIBRARY.decode(ids)


@pytest.mark.parametrize("step", [1, 2, 5])
@pytest.mark.parametrize("ids", [[197, 1, 131], [1, 197, 2, 1, 131, 131], [1, 2, 450, 1, 450], [1, 230, 197, 133]])
def test_a_piece_without_text_ends_a_character_begun(ids, step):
    machine = pieces.PieceText(pieces.piece_table(PIECES))
    parts = [machine.feed(array("I", ids[i : i + step])) for i in range(0, len(ids), step)]
    assert "".join(parts) + machine.end() == LIBRARY.decode(ids)


def test_every_piece_and_pairs_of_pieces():
    table, chance = pieces.piece_table(PIECES), random.Random(5)
    words = [LIBRARY.id_to_piece(i) for i in range(259, 32000)]
    texts = words[::7] + ["".join(chance.choices(words, k=chance.randrange(1, 6))) for _ in range(4000)]
    for text, ids in zip(texts, table.encode_all(texts)):
        assert list(array("I", ids)) == LIBRARY.encode(text)


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 20_000)
    monkeypatch.setattr(pieces, "TOGETHER", 500)
    table, chance = pieces.PieceTable(PIECES), random.Random(2)
    texts = [" ".join("".join(chance.choices("abcdeft", k=8)) for _ in range(30)) + "z" * chance.randrange(200) for _ in range(300)]
    for text, ids in zip(texts, table.encode_all(texts)):
        assert list(array("I", ids)) == LIBRARY.encode(text)
        assert table._held < 20_000 + 60_000
    assert not any(len(c) > pieces.SHORT for c in [*table._known, *table._older])


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i % 5 else None, t, "clash", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, n_a string").repartition(3)


def test_round_trip_of_odd_texts(odd):
    rows = odd.select("doc_id", "text", "row", pieces.round_trip(F.col("text"), PIECES).alias("t")).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        ids = LIBRARY.encode(r["text"] or "")
        assert r["row"] == "clash" and r["t"]["n_tokens"] == len(ids)
        assert r["t"]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["t"]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    both = odd.select("text", pieces.decoded(pieces.encoded(F.col("text"), PIECES), PIECES).alias("back")).collect()
    assert all(r["back"] == (r["text"] or "").replace("▁", " ") for r in both)
    assert odd.where("false").select(pieces.round_trip(F.col("text"), PIECES)).collect() == []


def plain_alignment(rows):
    """Offsets as sets, groups as lists, counts in one dictionary."""
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    letters = {letter: b for b, letter in enumerate(alignment.byte_letters())}
    found, counts = [], Counter()
    for key, text in rows:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = LIBRARY.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in library.id_to_token(i)) for i in a]
        spelled = [bytes([int(LIBRARY.id_to_piece(i)[3:5], 16)]) if LIBRARY.is_byte(i) else LIBRARY.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(bytes_a) == b"".join(spelled) == (" " + text).encode():
            found.append((key, 0, 0, [], ""))
            continue
        ends = [{sum(map(len, t[: i + 1])): i for i in range(len(t))} if len(t) < 200 else dict(zip(np.cumsum([*map(len, t)]).tolist(), range(len(t)))) for t in (bytes_a, spelled)]
        links, groups, from_a, from_b = [], [], 0, 0
        for end in sorted({*ends[0]} & {*ends[1]}):
            i, j = ends[0][end], ends[1][end]
            links.append((a[i], b[j]))
            groups.append(",".join(map(str, a[from_a : i + 1])) + "|" + ",".join(map(str, b[from_b : j + 1])))
            from_a, from_b = i + 1, j + 1
        counts.update(links)
        found.append((key, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(key, n_a, n_b, len(l), len(l), sum(counts[p] == best[p[1]] for p in l), sum(counts[p] for p in l), digest) for key, n_a, n_b, l, digest in found]


@pytest.mark.parametrize("keys, bucket", [(alignment.KEYS, alignment.BUCKET), (150, 40)])
def test_alignment_like_the_plain_version(spark, sf_dir, odd, monkeypatch, keys, bucket):
    monkeypatch.setattr(alignment, "KEYS", keys)
    monkeypatch.setattr(alignment, "BUCKET", bucket)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).unionByName(odd.select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("doc_id AS n_b", "text", "1 AS row")
    found = alignment.aligned(docs.withColumnRenamed("n_b", "keys"), ["keys"], "text", BYTES, PIECES)
    got = [(r["keys"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(plain_alignment(rows), key=repr)


def test_alignment_of_nothing(spark):
    for rows in ([], [(1, None)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = alignment.aligned(docs, ["doc_id"], "text", BYTES, PIECES).collect()
        assert [tuple(r) for r in found] == [(1, 0, 0, 0, 0, "", 0, 0)][: len(rows)]


def test_perfect_hash_is_minimal_and_knows_its_keys():
    chance = np.random.default_rng(1)
    keys = np.unique(chance.integers(0, 1 << 47, 20_000))
    rows = []
    for b in range(7):
        fields, ordered = alignment.build_hash(keys[alignment.bucket_of(keys, 7) == b])
        bits = np.packbits(np.concatenate(fields), bitorder="little").tobytes()
        rows.append({"bucket": b, "sizes": [*map(len, fields)], "bits": bits, "pairs": ordered.tobytes()})
    index = alignment.PerfectHash(rows, 7)
    assert sorted(index.index(keys)) == list(range(len(keys)))
    assert (index.index(keys + (1 << 48)) == -1).all()


def test_polynomial_and_roots():
    chance = np.random.default_rng(3)
    for d in (1, 2, 5, 9):
        half = chance.integers(-50, 50, (d, max(1, d - 1)))
        matrix = (half @ half.T).astype(object)
        trace = int(np.trace(matrix))
        primes = whitening.primes_for(2 * whitening.coefficient_bound(d, trace))
        coefficients = whitening.remaindered([whitening.polynomial_modulo(matrix, p).tolist() for p in primes], primes)
        wanted, step = [1], np.zeros((d, d), dtype=object)
        for k in range(1, d + 1):  # Faddeev and Leverrier's recursion, exact
            step = matrix.dot(step) + np.eye(d, dtype=int).astype(object) * wanted[-1]
            wanted.append(-int(np.trace(matrix.dot(step))) // k)
        assert coefficients == wanted[::-1]
        roots, wanted = whitening.Roots(coefficients, trace), np.linalg.eigvalsh(matrix.astype(float))[::-1]
        rank = roots.above(0)
        assert rank == np.linalg.matrix_rank(matrix.astype(float))
        found = [float(Fraction(roots.largest(k), 1 << roots.scale)) for k in range(1, rank + 1)]
        assert np.allclose(found, wanted[:rank])


def checked_whitening(rows, vectors, most=8):
    """The whitened values have the identity as covariance, lie along eigenvectors, and deviations are exact."""
    x = np.floor(1024 * np.array(vectors, dtype=float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    rank = np.linalg.matrix_rank(centred)
    k = min(most, rank)
    got = np.array([r["white"]["whitened"] for r in rows])
    assert got.shape == (n, k)
    assert np.allclose(got.T @ got / n, np.eye(k), atol=1e-9)
    assert [r["white"]["deviation"] for r in rows] == [int(s) for s in ((n * x - sums).astype(object) ** 2).sum(axis=1)]
    space = directions[:, ::-1][:, :k]
    assert np.allclose(got @ got.T, (centred @ space / values[::-1][:k]) @ (centred @ space).T, atol=1e-6)


def test_whitening_of_odd_vectors(spark):
    chance = np.random.default_rng(4)
    good = chance.normal(size=(40, 6)).round(4)
    good[5:9] = good[4]  # repeated rows
    rows = [(i, v.tolist()) for i, v in enumerate(good)]
    bad = [(90, None), (91, []), (92, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (93, [float("nan")] * 6), (94, [float("inf")] * 6), (95, [1.0, 2.0]), (96, [1e300] * 6)]
    df = spark.createDataFrame(rows[:7] + bad + rows[7:], "vec_id long, embedding array<double>").selectExpr("*", "'x' AS whitened")
    found, model = whitening.whitened(df.repartition(3), F.col("embedding"))
    got = sorted(found.collect(), key=lambda r: r["vec_id"])
    assert [r["vec_id"] for r in got] == list(range(40)) and got[0]["whitened"] == "x" and model.n == 40
    checked_whitening(got, good)
    assert whitening.identity_error(found.select("white.whitened"), len(model.components)) < 1e-9


def test_whitening_of_equal_roots_large_entries_and_nothing(spark):
    corners = np.array([[a, b, c] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)], dtype=float)  # three equal roots
    far = corners * 2.0**40 + np.arange(8)[:, None] * [0, 0, 2.0**20]
    for vectors in (corners, far):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        found, _ = whitening.whitened(df, F.col("embedding"))
        got = np.array([r["white"]["whitened"] for r in sorted(found.collect(), key=lambda r: r["vec_id"])])
        assert np.allclose(got.T @ got / 8, np.eye(3), atol=1e-9)
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    for df in (none, same):
        found, model = whitening.whitened(df, F.col("embedding"))
        assert model.components == [] and all(r["white"]["whitened"] == [] for r in found.collect())
        assert whitening.identity_error(found.select("white.whitened"), 0) in (None, 0.0)


def test_whitening_query(spark, sf_dir):
    rows = queries.op13_exact_whitening(spark, sf_dir).collect()
    assert {r["component"] for r in rows} == set(range(1, 9)) and all(r["identity_error"] < 1e-9 for r in rows)
    explained = {r["component"]: r["explained"] for r in rows}
    assert sorted(explained.values(), reverse=True) == [explained[k] for k in range(1, 9)]
