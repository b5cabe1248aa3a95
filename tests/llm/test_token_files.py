import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mastline.llm import token_files as K
from mastline.llm.queries import QUERIES, tokenizer_path
from mastline.workspace import new_folder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def expected(rows, library):
    """Rows in ascending id order, ids unique."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library(text or ""), 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def plain(df):
    assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    return sorted(map(tuple, df.collect()), key=lambda r: r[1])


def test_whole_table_equals_the_library(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert plain(QUERIES["op3_token_id_output"](spark, SF)) == expected(rows, library)


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0, 1, 2], [0, 5, 5, 900, 10**12], list(range(0, 10**6, 997))])
def test_elias_fano_round_trip(values):
    code = K.EliasFano.encode(np.array(values))
    assert code.decode().tolist() == values
    assert [code.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        code.select(len(values))


def test_elias_fano_space():
    values = np.sort(np.random.default_rng(0).integers(0, 10**9, 10**5))
    code = K.EliasFano.encode(np.concatenate([[0], values]))
    assert 8 * (len(code.low) + len(code.high)) < 10**5 * (2 + np.log2(10**4)) + 64
    assert code.decode()[1:].tolist() == values.tolist()


def test_pieces_give_the_ids_of_the_library(library):
    rng = random.Random(0)
    parts = ["a", "Hello", "'s", "don't", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", " ", "\x1c", "\x85", "é", "ß", "123", "!!", "<|endoftext|>", "　", "中文", "😀", " x", "x "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000)]
    encoder = K.Encoder(tokenizer_path())
    found = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)]
    assert found == [library(t) for t in texts]


def test_added_tokens_have_ids_of_their_own(spark):
    plain_library = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    parts = ["a", "Hello", "don't", " ", "  ", "\n", "\t", "!!", "<|endoftext|>", "<|endoftext", "|>", "é", "x "]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "a\n<|endoftext|>\nb"]
    texts += ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(500)]
    rows = list(enumerate(texts))
    folder = new_folder(spark, "tokens")
    K.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, tokenizer_path())
    ids = lambda text: plain_library.encode(text, add_special_tokens=False).ids
    assert 50256 in ids(texts[0])
    assert plain(K.read(spark, folder)) == expected(rows, ids)


def test_a_full_memory_of_pieces(library, monkeypatch):
    monkeypatch.setattr(K, "_KNOWN", 3)
    encoder = K.Encoder(tokenizer_path())
    for texts in (["a b c d e"], ["f g a"], ["a b"]):
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == [library(t) for t in texts]


def test_odd_rows(spark, library):
    schema = "doc_id long, text string, start string, part int"
    rows = [(5, "five"), (None, "none"), (2, None), (-7, ""), (9, "very long " * 30_000), (3, "a\nb  c")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], schema)
    folder = new_folder(spark, "tokens")
    K.write(docs, folder, tokenizer_path(), shard_tokens=4)
    assert plain(K.read(spark, folder)) == expected(rows, library)
    shards = spark.read.parquet(folder).collect()
    assert len(shards) > 2 and all(r["n_tokens"] < 4 + 60_003 for r in shards)
    for r in shards:  # select reads one boundary
        code = K.boundaries(r["n_docs"], r["low_bits"], r["low"], r["high"], r["samples"])
        assert code.select(r["n_docs"]) == r["n_tokens"] == len(r["tokens"]) // r["width"]
    empty = new_folder(spark, "tokens")
    K.write(docs.where(F.lit(False)), empty, tokenizer_path())
    assert plain(K.read(spark, empty)) == []


def test_repeated_ids_are_all_written(spark, library):
    rows = [(1, "x y"), (1, "x y"), (1, "z"), (1, None), (0, "q")]
    folder = new_folder(spark, "tokens")
    K.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, tokenizer_path())
    found = plain(K.read(spark, folder))
    assert sorted((r[0], r[2], r[3]) for r in found) == sorted((r[0], r[2], r[3]) for r in expected(rows, library))
    assert [r[1] for r in found[1:]] == np.cumsum([r[2] for r in found])[:-1].tolist()


def test_words_by_the_model_alone_are_those_of_the_library(spark):
    """All words of the larger table, and every Latin letter, in the ways a piece can stand."""
    encoder = K.Encoder(tokenizer_path(), added_tokens=True)
    library = encoder._ids
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").toPandas()["text"]
    words = {w.rstrip(".,") for t in texts for w in t.split()}
    words |= {chr(i) for i in range(0x250)} | {f"ab{chr(i)}c" for i in range(0x250)}
    matches = [K._WORD.fullmatch(w) for w in words]
    words = sorted(m[1] for m in matches if m and not m[2])
    pieces = [*words, *("\n" + w for w in words[::5])]
    found = list(encoder._words(pieces))
    assert len(pieces) > 50_000
    assert found == library([p if p[0] == "\n" else " " + p for p in pieces])


def test_a_small_memory_and_slices_of_any_size_change_nothing(library, monkeypatch):
    monkeypatch.setattr(K, "_KNOWN", 8)
    encoder = K.Encoder(tokenizer_path(), added_tokens=True)
    texts = ["", " ", "one", "one two, two... \nthree", "été, l'été; ﬁn\tx y", "a  b", "x\n\ny", "z! "] * 3
    texts += [f"word{i} wörd, w{'o' * i}rd\nnext{i}." for i in range(60)]
    for size in (1, 3, len(texts)):
        runs = [texts[i : i + size] for i in range(0, len(texts), size)]
        found = [np.frombuffer(x, "<u2").tolist() for run in runs for x in encoder.encode(run)]
        assert found == [library(t) for t in texts]
    assert encoder.encode([]) == []


def test_slices_cover_every_row(monkeypatch):
    monkeypatch.setattr(K, "_SLICE", 5)
    texts = ["abcdef", None, "", "ab", "abc", "abcd", "x" * 30, ""]
    batch = K.pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    runs = [s.column(1).to_pylist() for s in K._slices(batch)]
    assert [t for run in runs for t in run] == texts
    assert all(len(run) == 1 or sum(len(t or "") for t in run) <= 5 for run in runs)


def test_words_and_marks_are_cut_as_the_pattern_cuts_them():
    """ASCII words are told without the pattern; odd letters, marks and line feeds agree too."""
    heads = ["", "\n", "\n\n", "-", "4", "\t"]
    words = ["", "word", "Wört", "ǅ", "ﬁn", "词", "a1", "a_b", "ª", "É", "á", "a\n", "don't"]
    marks = ["", ".", "?!", "\n", "…", ".a", "_", "\\", "]^", ".\n", "«"]
    for piece in (h + w + m for h in heads for w in words for m in marks):
        found = K._WORD.fullmatch(piece)
        assert K._word_and_marks(piece) == (found and found.groups()), piece
