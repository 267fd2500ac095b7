import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from tilewright.llm.sentence_pieces import NONE, SCALE, best_path, chunk_matrix, combine, composed, decode, encode, encode_text, enters, leaves_of, load, piece_bytes, product, scores_before, transfer_matrix

PATH = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as file:
        return file.read()


def _texts(r, n):
    vocabulary = ["the", "tion", "hering", "état", "ñandú", "▁", "日本語テキスト", "\n", "  ", "x" * 40, "addEventListener", "\U0001f600", "........"]
    return [r.choice(["", " ", "\n"]) + "".join(r.choice(vocabulary) + r.choice(["", " "]) for _ in range(r.randrange(0, 14))) for _ in range(n)]


def test_scores_match_the_library_on_the_same_pieces(model):
    pieces = load(model)
    own = proto.ModelProto.FromString(model)
    own.trainer_spec.model_type = 1
    for p in own.pieces:
        text = p.piece.replace("▁", " ")
        if text in pieces.by_text and p.type in (1, 4):
            p.score, p.type = pieces.by_text[text][1] / SCALE, 1
    library = sentencepiece.SentencePieceProcessor(model_proto=own.SerializeToString())

    def total(ids):
        return sum(pieces.by_text[library.id_to_piece(i).replace("▁", " ")][1] for i in ids if not library.is_byte(i))

    for text in _texts(random.Random(1), 150):
        text = text.replace("▁", "")
        if text:
            got, want = encode_text(" " + text, pieces), library.encode(text)
            assert library.decode(got) == text and len([i for i in got if library.is_byte(i)]) == len([i for i in want if library.is_byte(i)])
            assert abs(total(got) - total(want)) <= 2, text


def test_matrices_are_associative_and_chunks_keep_the_best_score(model):
    pieces, r = load(model), random.Random(2)
    wide = pieces.longest
    for text in ["".join(_texts(r, 12)) + "y" * r.randrange(60) for _ in range(6)]:
        size = r.choice([17, 25, 40])
        cuts = list(range(0, len(text), size))
        ms = [chunk_matrix(text[c : c + size + wide], len(text) - c if c == cuts[-1] else size, pieces, c == cuts[-1]) for c in cuts]
        for c, m in zip(cuts, ms):
            assert (m == transfer_matrix(text[c : c + size + wide], len(text) - c if c == cuts[-1] else size, pieces, c == cuts[-1])).all()
        if len(ms) > 2:
            assert (combine(combine(ms[0], ms[1]), ms[2]) == combine(ms[0], combine(ms[1], ms[2]))).all()
        whole = ms[0]
        for m in ms[1:]:
            whole = combine(whole, m)
        assert whole[0, 0] == best_path(text, pieces)[0]
        start = np.full(wide, NONE, np.int64)
        start[0] = 0
        before = [np.frombuffer(v, np.int64) for v in scores_before([m.tobytes() for m in ms], start.tobytes())]
        ends = [len(text) - c if c == cuts[-1] else size for c in cuts]
        tables = [enters(text[c : c + size + wide], n, v, pieces, c == cuts[-1]) for c, n, v in zip(cuts, ends, before)]
        left = leaves_of([t.tobytes() for t in tables], np.int32(0).tobytes())
        ids = []
        for c, n, t, x in zip(cuts, ends, tables, left):
            x = int(np.frombuffer(x, np.int32)[0])
            ids += best_path(text[c + int(t[x]) : c + n + x], pieces)[1]
        assert tuple(ids) == best_path(text, pieces)[1]
        if len(ms) > 2:
            raw = [m.tobytes() for m in ms]
            assert product([product(raw[:2]), product(raw[2:])]) == product(raw)
            own = [t.tobytes() for t in tables]
            assert composed([composed(own[:2]), composed(own[2:])]) == composed(own)


def test_round_trip_of_short_giant_and_odd_texts(spark):
    r = random.Random(3)
    texts = [None, "", " ", "▁", "a", "\n\n", *_texts(r, 20), "".join(_texts(r, 60)), "z" * 900 + " " + "q" * 500, " " * 700]
    docs = spark.createDataFrame([(i % 20, t, "old", i) for i, t in enumerate(texts)], "doc_id long, text string, ids string, key int").repartition(3)
    pieces = load(open(PATH, "rb").read())
    for chunk, fan in ((50, 2), (100, 3), (173, 64)):
        got = decode(encode(docs, PATH, chunk=chunk, fan=fan), PATH).collect()
        assert len(got) == len(texts) and all(g["text"] == g["decoded"] == texts[g["key"]] for g in got)
        for g in got:
            assert g["ids"] == (None if g["text"] is None else encode_text(" " + g["text"], pieces) if g["text"] else [])


def test_a_unigram_model_encodes_as_the_library_does(spark, tmp_path):
    r = random.Random(4)
    m = proto.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.name, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix = "identity", False, True
    add = lambda piece, score, kind: m.pieces.add(piece=piece, score=score, type=kind)
    add("<unk>", 0, 2)
    for b in range(256):
        add(f"<0x{b:02X}>", 0, 6)
    # scores that no two sums of share, so that there is one best path
    for piece in sorted({"▁", *"abcde", *("".join(r.choices("▁abcde", k=1) + r.choices("abcde", k=r.randrange(1, 6))) for _ in range(300))}):
        add(piece, -r.randrange(200_000, 900_000) / SCALE, 1)
    path = tmp_path / "unigram.model"
    path.write_bytes(m.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = ["".join(r.choices("abcde  é\n", k=r.randrange(400))) for _ in range(60)]
    got = {g["text"]: g["ids"] for g in encode(spark.createDataFrame([(t,) for t in texts], "text string"), str(path), chunk=60, fan=2).collect()}
    # an unknown character ends runs there as it does here
    assert all(got[t] == library.encode(t) for t in texts)


def test_empty_table(spark):
    assert decode(encode(spark.createDataFrame([], "doc_id long, text string"), PATH), PATH).count() == 0


def test_decoding_holds_no_more_than_the_bytes_of_ids(model):
    whole = load(model)
    assert piece_bytes(model) == (whole.as_bytes, whole.dummy_prefix)
