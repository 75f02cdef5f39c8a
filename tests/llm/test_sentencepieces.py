import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from turnwise.llm.sentencepieces import _PIECE, _STEP, decode, decoded, encode, encoded
from turnwise.llm.text import mix, span_hashes

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_no_dropout_is_the_model_itself_and_dropout_is_lossless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    exact = {r.doc_id: r for r in decode(encode(docs, PATH, dropout=0.0), PATH).collect()}
    assert all(r.ids == model.encode(r.text) and r.decoded == r.text for r in exact.values())
    one = {r.doc_id: r for r in decode(encode(docs, PATH, dropout=0.3, seed=1), PATH).collect()}
    two = {r.doc_id: r.ids for r in encode(docs, PATH, dropout=0.3, seed=2).collect()}
    assert all(r.decoded == r.text for r in one.values())
    assert sum(one[i].ids != two[i] for i in two) > 0.9 * len(two)
    assert sum(len(x) for x in two.values()) > sum(len(r.ids) for r in exact.values())


def test_edges(spark):
    texts = [None, "", " ", "  two  spaces ", "a\n\n b\tc\r", "▁ sign ▁▁x", "日本 é😀 \x00z", "x" * 20000, " lead", "lead "]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, decoded int")
    for p in (0.0, 0.5):
        got = {r.doc_id: r for r in decode(encode(docs, PATH, dropout=p), PATH).collect()}
        assert [got[i].decoded for i in range(len(texts))] == texts
    assert got[0].ids is None and got[1].ids == []
    assert encode(docs.limit(0), PATH).count() == 0


def test_each_occurrence_of_a_word_has_its_own_merges(spark):
    text = " thing is understandable" * 200
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, text)], "doc_id long, text string")
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    forms = {}
    for r in encode(docs, PATH, dropout=0.1, seed=1).collect():
        words = "".join(model.id_to_piece(i) + "|" for i in r.ids).split("▁")
        forms[r.doc_id] = [w for w in words if w.replace("|", "") == "understandable"]
    plain = "".join(model.id_to_piece(i) + "|" for i in model.encode(" understandable")).split("▁")[-1]
    assert all(len(x) > 150 and len(set(x)) > 3 and 0 < x.count(plain) < len(x) for x in forms.values())
    assert forms[1] == forms[3] and forms[1] != forms[2][: len(forms[1])]


def plain_loop(pieces, text, dropout, seed):
    """The agenda of merges, one candidate at a time, over strings."""
    led = (" " + text).replace(" ", "\0")
    order = {"".join("\0" if c == "▁" else c for c in name): (rank, i) for name, rank, i in pieces}
    salt = int(mix(span_hashes(np.frombuffer((" " + text).encode(), np.uint8), np.array([0]), np.array([len(text.encode()) + 1])) ^ mix(np.array([seed], np.uint64)))[0])
    symbols, tried = [(i, c) for i, c in enumerate(led)], set()
    while True:
        found = [(*order[a + b], i, k) for k, ((i, a), (_, b)) in enumerate(zip(symbols, symbols[1:])) if a + b in order and (i, a, b) not in tried]
        if not found:
            return [order[s][1] if s in order else s for _, s in symbols]
        _, piece, i, k = min(found, key=lambda x: (x[0], x[2]))
        a, b = symbols[k][1], symbols[k + 1][1]
        drawn = mix(np.array([salt], np.uint64) ^ mix(np.array([i], np.uint64) * _STEP + np.array([piece], np.uint64) * _PIECE))[0]
        if float(drawn) < dropout * 2.0**64:
            tried.add((i, a, b))
        else:
            symbols[k : k + 2] = [(i, a + b)]


def test_ids_are_those_of_a_plain_agenda_loop():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    pieces = [(model.id_to_piece(i), -model.get_score(i), i) for i in plain]
    texts = ["a thing of understandable beauty, is it not?  indeed\n\nso", "international " * 9, "supercalifragilistic" * 12, "zzz", "é😀 日本語"]
    for dropout in (0.0, 0.1, 0.5, 0.9):
        ids = encoded(pa.array(texts), PATH, dropout, 3).to_pylist()
        for text, got in zip(texts, ids, strict=True):
            want = []
            for x in plain_loop(pieces, text, dropout, 3):
                want += [x] if isinstance(x, int) else [model.piece_to_id(f"<0x{b:02X}>") for b in x.replace("\0", " ").encode()]
            assert got == want
        assert decoded(pa.array(ids, pa.list_(pa.int32())), PATH).to_pylist() == texts


def test_skips_come_at_the_rate_and_one_word_gets_several_forms():
    text = " ".join(["international"] * 3000)
    whole, some = (encoded(pa.array([text]), PATH, d, 9)[0].as_py() for d in (0.0, 0.1))
    assert len(whole) == 3000 and len(some) > 3100
    # the last merge of a word is skipped at the rate of the dropout, if it comes up
    assert 0.3 < sum(x == whole[0] for x in some) / 3000 < 0.95


def test_repeated_rows_null_ids_and_other_columns(spark):
    rows = [(None, "some text", 1), (None, "some text", 2), (7, "some text", 3), (7, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = encode(docs, PATH, dropout=0.5, decoded_col="text2").collect()
    assert len(got) == 4 and sorted(got[0].asDict()) == ["doc_id", "ids", "text", "text2"]
    assert len({tuple(r.ids) for r in got if r.text}) == 1 and all(r.text == r.text2 for r in got)
