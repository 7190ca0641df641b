import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from scangraph.llm.arrow_tokens import SEQUENCE, open_sequences, pack_stream, read_tokens, sequence, write_tokens
from scangraph.llm.byte_bpe import TOKENIZER, ByteBpe, byte_bpe
from scangraph.llm.common import texts, tokenizer_path
from scangraph.llm.maxplus_pieces import decode_pieces, encode_pieces, merge_pieces, round_trip
from scangraph.llm.merge_chunks import MergeChunk, product
from scangraph.llm.piece_bpe import piece_bpe
from scangraph.llm.residual_packing import best_fit, pack_pieces, packed_sequences, token_pieces
from scangraph.llm.trie_counts import token_counts, trie_counts
from scangraph.llm.unigram import Unigram, unigram

SPACES = ["a\nb", "a\n\nb c", "a\n\n\nb", "a \n b", "a\n b\tc", "a\n", "a\n\n", "a b \n", "x...!! y's, 'z'.\n'd", "²,½. a_b_. é!?\x85b", "ab\u3000\n c"]
SPACES += ["", " ", "  ", "a  b", "a   b", " \n x", "x \n", "it's 'll", "a.b, c.,", "é,", ".", " , .", "x\x00 y", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def test_words_have_the_ids_of_the_library(library, odd_rows):
    for text in SPACES + [t for _, t in odd_rows if t]:
        assert np.frombuffer(byte_bpe().ids(text.encode()), "<u2").tolist() == library(text), text


def test_texts_together_have_the_ids_of_the_library(library):
    rng = random.Random(3)
    parts = ["a", "the", "Über", "日本", "12", "x²", " ", " ", " ", "\n", "\n", "\t", "\x0b", "\xa0", ".", ",", "'s", "!!", "_", "\0", "\r\n"]
    bodies = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    found = [np.frombuffer(ids, "<u2").tolist() for ids in byte_bpe().ids_of([b.encode() for b in bodies])]
    assert found == [library(b) for b in bodies]
    assert list(byte_bpe().ids_of([])) == []


def test_a_worker_keeps_few_parts():
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(w) for w in itertools.islice(itertools.product(letters, repeat=4), 450_000)]
    model = ByteBpe(tokenizer_path(TOKENIZER))
    for at in range(0, len(words), 10_000):
        list(model.ids_of([" ".join(words[at : at + 10_000]).encode()]))
    # They stay in memory beside what later steps of a pipeline take.
    assert len(model._parts) + len(model._parts.older) <= 400_000


def test_arrow_tokens(spark, table, odd_rows, library, tmp_path):
    docs = table(odd_rows)
    write_tokens(docs, str(tmp_path / "tokens"), length=64, file_tokens=1000)
    found = read_tokens(spark, str(tmp_path / "tokens")).orderBy("start").collect()
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    expected, start = Counter(), 0
    for doc_id, text in odd_rows:
        own = np.array([*library(text), 0], "<u4")
        expected[doc_id, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected
    for r in found:
        assert r.start == start
        start += r.n_tokens
    file = next((tmp_path / "tokens").glob("part*"))
    rows = open_sequences(file)
    tokens, mask = sequence(rows, rows.num_rows - 1)
    assert len(tokens) == len(mask) == 64 and mask[0] and not tokens.flags.owndata


def test_empty_tables(spark, table, tmp_path):
    empty = table([])
    write_tokens(empty, str(tmp_path / "none"))
    assert read_tokens(spark, str(tmp_path / "none")).collect() == []
    assert pack_pieces(token_pieces(empty)).collect() == []
    assert encode_pieces(empty).collect() == [] and token_counts(empty).collect() == []
    assert merge_pieces(empty).collect() == [] and round_trip(empty).collect() == []


def test_stream_pads_its_last_sequence_only():
    documents = [(1, 0, np.arange(70, dtype="<u2").tobytes()), (None, 1, np.arange(5, dtype="<u2").tobytes())]
    rows = open_sequences(pack_stream(documents, 32, "<u2", 0, 0))
    masks = [sequence(rows, i)[1].sum() for i in range(rows.num_rows)]
    assert masks == [32, 32, 11] and SEQUENCE == 2048


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fills = best_fit([6, 5, 4, 3, 2], 10)
    assert fills == [10, 10] and bins == [0, 1, 0, 1, 1] and offsets == [0, 0, 6, 5, 8]


def test_packing(table, odd_rows, library):
    pieces = token_pieces(table(odd_rows), capacity=256, keep_ids=True)
    # Small tasks and bounds, so that sequences go up several rounds.
    packed = pack_pieces(pieces.drop("ids"), capacity=256, task_pieces=8, carried=6, fan_in=2)
    rows = packed.collect()
    assert Counter((r.doc_id, r.start, r.length) for r in rows) == Counter(
        (doc_id, max(0, end - 256), end - max(0, end - 256))
        for doc_id, text in odd_rows
        for end in range((len(library(text))) % 256 + 1, len(library(text)) + 2, 256)
    )
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    total = sum(r.length for r in rows)
    assert max(sequences.values()) <= 256 and len(sequences) <= -(-total // 256) + 2
    joined = packed_sequences(pieces, packed).collect()
    assert sum(len(r.ids) // 4 for r in joined) == total and len(joined) == len(sequences)


def plain(model, text):
    return [model.segment(part) for part in model.segments(model.escape(text))]


@pytest.mark.parametrize("chunk,fan_in", [(5, 2), (37, 3), (1 << 14, 32)])
def test_chunks_find_what_one_scan_finds(table, odd_rows, chunk, fan_in):
    short = [(i, t) for i, t in odd_rows if chunk > 1000 or len(t or "") < 400]
    model, docs = unigram(), table(short + [(50, "a▁b ▁"), (51, "ab" * 90), (52, "日" * 90)])
    encoded = encode_pieces(docs, chunk=chunk, fan_in=fan_in)
    scores = {r.row_id: r.score for r in encoded.collect()}
    back = {r.row_id: r.text for r in decode_pieces(encoded).collect()}
    for r in texts(docs).collect():
        text = bytes(r.text).decode()
        assert back[r.row_id] == text and scores[r.row_id] == sum(s for _, s in plain(model, text))


def test_scores_are_the_best_of_all_segmentations():
    model = unigram()

    def best(text):
        if not text:
            return 0.0
        ends = range(1, len(text) + 1)
        heads = [(model.pieces[text[:e]][1], text[e:]) for e in ends if text[:e] in model.pieces]
        if text[0] not in model.pieces:
            heads.append((model.unknown_score, text[1:]))
        return max(score + best(rest) for score, rest in heads)

    for text in ["▁hello", "▁thing", "▁xqz日", "▁▁a"]:
        assert model.segment(text)[1] == best(text)


def test_counts_agree_with_the_encoder(table, odd_rows):
    docs = table(odd_rows)
    counts = Counter((r.doc_id, r.n_tokens, r.score) for r in token_counts(docs).collect())
    pieces = Counter((r.doc_id, r.n_pieces, r.score) for r in round_trip(docs).collect())
    assert counts == pieces


def test_last_tokens_of_all_prefixes():
    from scangraph.llm.piece_bpe import piece_bpe

    model, rng = piece_bpe(), random.Random(4)
    letters = ["th", "e", "in", "g", "▁", "x", "日", "😀", "re", "ation", "S", ".", "1"]
    words = {"▁" + "".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) for _ in range(400)}
    words |= {"▁" + "".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 12))) for _ in range(400)}
    for word, sizes, n, score in model.walk(words):
        assert model.ids(word, sizes) == model.library.encode(word) and n == len(model.library.encode(word))
        assert score == sum(model.scores[i] for i in model.library.encode(word))
        for end in range(1, len(word) + 1):  # one token ends at each place, that of the prefix's encoding
            assert model.ids(word[:end], sizes[: end + 1]) == model.library.encode(word[:end])


def test_a_giant_text_without_blanks(table):
    from scangraph.llm.piece_bpe import piece_bpe

    rng = random.Random(8)
    body = "".join(rng.choice(["th", "e", "ing", "s", "at", "ion", "r", "日"]) for _ in range(120_000))
    (row,) = merge_pieces(table([(1, body)]), chunk=1 << 13, fan_in=4).collect()
    assert len(body) > 200_000
    assert np.frombuffer(row.ids, "<u4").tolist() == piece_bpe().library.encode("▁" + body)
    assert row.decoded_sha256 == hashlib.sha256(body.encode()).hexdigest()


def test_trie_shares_prefixes():
    model = Unigram(tokenizer_path("piece_bpe_32k.model"))
    words = {"▁th", "▁the", "▁then", "▁thing", "▁x", "▁日本", "▁"}
    assert trie_counts(model, words) == {w: (len(ids), s) for w in words for ids, s in [model.segment(w)]}


def test_pieces_are_those_of_the_library(table, odd_rows):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    more = [" a ", "a▁b ▁", "a" + " " * 40 + "b", "x\x00 y\t\n", "😀 naïve ﷐", " ", "unrelated  thingamabobs"]
    rows = odd_rows + list(enumerate(more, 50))
    expected = [(doc_id, library.encode(text or "")) for doc_id, text in rows]
    docs = table(rows)
    for chunk, fan_in in ((5, 2), (40, 3), (1 << 14, 32)):
        if chunk == 5:
            few = [(d, t) for d, t in rows if len(t or "") < 300] + [(90, "ab" * 60 + "thing"), (91, "日本x" * 20)]
            found = merge_pieces(table(few, "few"), chunk=chunk, fan_in=fan_in).collect()
            ids = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in found)
            assert ids == Counter((d, tuple(library.encode(t or ""))) for d, t in few)
            continue
        found = merge_pieces(docs, chunk=chunk, fan_in=fan_in).collect()
        ids = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.score) for r in found)
        assert ids == Counter((d, tuple(i), float(sum(map(library.get_score, i)))) for d, i in expected)
    crcs = Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in expected)
    assert Counter((r.doc_id, r.n_pieces, r.ids_crc32) for r in round_trip(docs).collect()) == crcs
    counts = Counter((r.doc_id, r.n_tokens) for r in token_counts(docs).collect())
    assert counts == Counter((d, len(i)) for d, i in expected)


def test_pieces_that_end_at_a_place_come_from_one_step_per_character():
    model, rng = piece_bpe(), random.Random(5)
    names = list(model.pieces)
    for _ in range(200):
        text, state = "".join(rng.choice(names) for _ in range(6)) + "\U0001f600" + rng.choice(names), 0
        for end in range(1, len(text) + 1):
            state = model._step(state, text[end - 1])
            fitting = [text[start:end] for start in range(max(0, end - model.longest), end) if text[start:end] in model.pieces]
            assert list(model._ends[state]) == [(len(p), model.pieces[p]) for p in fitting]


def test_middles_of_chunks_are_encoded_together():
    model, rng = piece_bpe(), random.Random(6)
    chunks = []
    for _ in range(200):
        text = model.escape("".join(rng.choice("ab  é\n") for _ in range(rng.randint(1, 60))))
        at = rng.randint(0, min(model.longest, len(text) - 1))
        size = rng.randint(1, len(text) - at)
        chunk = MergeChunk(model, text, at, size, at == 0, at + size == len(text))
        places = np.cumsum([at, *map(len, model.segments(text[at : at + size]))])[1:-1].tolist()
        assert chunk.inner == ((places[0], places[-1]) if places else None)
        chunks.append(chunk)
    found = [np.frombuffer(ids, "<u4").tolist() for _, _, _, ids in model.encode_escaped([c.middle() for c in chunks])]
    assert found == [model.library.encode(c.middle()) for c in chunks]


def test_products_of_states_are_those_of_all_paths():
    rng = np.random.default_rng(7)
    for share in (0.0, 0.01, 0.2):
        left, right = (rng.random((37, 37)) < share for _ in range(2))
        assert (product(left, right) == (left[:, :, None] & right[None]).any(axis=1)).all()
