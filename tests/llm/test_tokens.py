"""Packing, BPE, token files and token counts against the tokenizers library."""

import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stayline.llm import bpe, byte_ids, packing, token_counts, token_files

CHARS = [" ", "  ", "\n", "a", "B", "é", "é", "Σ", "ß", "1", "½", "'s", "'LL", "'re", "'r", "'", "<|endoftext|>",
         "<|startoftext|>", " ", "\x1c", "\x85", "　", "漢字", "\U0001f600", "_", "...", "İ", "\t", "\r\n", "the", "ing", "    "]


def fuzz(n):
    pick = random.Random(5)
    return ["".join(pick.choices(CHARS, k=pick.randint(0, 40))) for _ in range(n)]


def test_unit_encoder_equals_the_library(byte_bpe, ids_of):
    texts = fuzz(1500)
    got = byte_ids.UnitEncoder(byte_bpe).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t).tolist() for t in texts]


def test_quick_encoder_equals_the_library_below_its_bound(byte_bpe, ids_of):
    coder, pick = byte_ids.UnitEncoder(byte_bpe), random.Random(9)
    assert coder.quick is not None
    near = [chr(c) for c in range(0x260)]
    texts = [c + d for c in near for d in (" ", "a", "1", ".", "\n", "'s")] + [f"x {c}{d}a" for c in near for d in " a1.\n"]
    texts += ["".join(pick.choice(near) if pick.random() < 0.5 else pick.choice("ab 1.\n'") for _ in range(30)) for _ in range(3000)]
    texts += [" ".join("".join(pick.choices("abcdefghiéßñstr", k=pick.randint(1, 70))) + pick.choice(["", ",", ".\n", "%%", "'ll"])
                       for _ in range(300)) for _ in range(20)]
    got = coder.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t).tolist() for t in texts]


def test_quick_encoder_needs_ranked_merges(byte_bpe):
    def changed(change):
        own = json.loads(Tokenizer.from_file(byte_bpe).to_str())
        change(own)
        return byte_ids.ranked(Tokenizer.from_str(json.dumps(own)))

    def swap(own):
        merges = own["model"]["merges"]
        merges[10], merges[11] = merges[11], merges[10]

    def drop(own):
        del own["model"]["merges"][-1]  # a token that no pair makes

    def prefixed(own):
        own["pre_tokenizer"]["add_prefix_space"] = True

    assert [changed(c) for c in (swap, drop, prefixed)] == [None] * 3
    assert byte_ids.ranked(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))) is None


def test_bpe_equals_the_library_and_round_trips():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    library.no_truncation()
    library.no_padding()
    for text in fuzz(1500):
        ids, decoded = own.round_trip(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want == own.encode(text)
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_merge_queue_skips_stale_entries():
    merges = {(1, 2): (0, 9), (2, 1): (1, 8), (9, 9): (2, 7)}
    assert bpe.merge_symbols([1, 2, 1, 2], merges) == [7]
    assert bpe.merge_symbols([2, 1, 2, 1], merges) == [2, 9, 1]
    assert bpe.merge_symbols([], merges) == [] and bpe.merge_symbols([5], merges) == [5]


def test_encode_decode_on_odd_rows(odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.encode_decode(odd, path).collect()
    assert len(rows) == 12 and sum(r.n_tokens == 0 for r in rows) == 3
    assert bpe.encode_decode(empty, path).count() == 0


def test_transducer_counts(byte_bpe, ids_of):
    model = token_counts.Transducer(byte_bpe)
    for text in fuzz(1200):
        assert model.count(text) == len(ids_of(text))


@pytest.mark.parametrize(("chunk", "look_back", "fan_in"), [(5, 3, 2), (9, 0, 64), (40, 40, 3)])
def test_state_maps_are_closed_and_composed(spark, byte_bpe, ids_of, monkeypatch, chunk, look_back, fan_in):
    """Entries that the characters before a chunk don't tell are found from the exits; trees of any width agree."""
    monkeypatch.setattr(token_counts, "FAN_IN", fan_in)
    pick = random.Random(5)
    texts = [*fuzz(150), "".join(pick.choice("abcdefgh") for _ in range(700)), "'" * 50, " " * 90 + "x", "ab" * 99 + "'s it's'll"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = token_counts.count_tokens(docs, byte_bpe, chunk=chunk, look_back=look_back).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(ids_of(t)) for i, t in enumerate(texts)}


def test_a_long_text_without_a_space_is_spread(spark, byte_bpe, ids_of):
    pick = random.Random(6)
    text = "".join(pick.choice("aeioubcdfglmnprstéß") for _ in range(400_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = token_counts.count_tokens(docs, byte_bpe, chunk=5_000).collect()[0]
    assert (row.doc_id, row.n_bytes, row.n_tokens) == (1, len(text.encode()), len(ids_of(text)))


def test_transducer_survives_a_full_table(byte_bpe, ids_of, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_EDGES", 50)
    model = token_counts.Transducer(byte_bpe)
    assert all(model.count(t) == len(ids_of(t)) for t in fuzz(200))


def test_count_tokens_cuts_long_texts(odd, empty, odd_rows, byte_bpe, ids_of):
    want = Counter((i, len((t or "").encode()), len(ids_of(t))) for i, t, *_ in odd_rows)
    for chunk in (70, 65_536):
        assert Counter(map(tuple, token_counts.count_tokens(odd, byte_bpe, chunk=chunk).collect())) == want
    assert token_counts.count_tokens(empty, byte_bpe).count() == 0


def check_pieces(rows, want, length):
    """want: all documents' ids, as many times as they occur."""
    made, sequences = {}, {}
    for r in rows:
        assert r.length == len(r.ids) // 4
        made.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    for key, ids in want.items():
        pieces = sorted(made[key], key=lambda r: r.start)
        assert b"".join(p.ids for p in pieces) == ids.tobytes()
    padding = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for p in pieces:
            assert p.offset == at
            at += p.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_packing_is_exact_at_every_fan_in(spark, odd, empty, odd_rows, byte_bpe, ids_of):
    docs = odd.filter("doc_id is null or doc_id != 8").repartition(7)
    want = {i: np.append(ids_of(t), 1).astype("<u4") for i, t, *_ in odd_rows if i != 8}
    for fan_in, windows in ((2, 1), (256, 64)):
        rows = packing.pack(docs, byte_bpe, length=64, open_windows=windows, fan_in=fan_in).collect()
        assert check_pieces(rows, want, 64) == 0
    assert packing.pack(odd, byte_bpe).agg(F.sum("length")).first()[0] == sum(len(ids_of(t)) + 1 for _, t, *_ in odd_rows)
    assert packing.pack(empty, byte_bpe).count() == 0


def test_packer_takes_the_tightest_window():
    packer = packing.Packer(10, 2)
    piece = lambda i, n: packing.Piece(i, 0, n, bytes(4 * n))
    assert not [*packer.add(piece(1, 7)), *packer.add(piece(2, 4))]
    full = [*packer.add(piece(3, 3))]  # fits both, fills the fuller
    assert [[p.doc_id for p in w] for w in full] == [[1, 3]]
    assert not [*packer.add(piece(4, 8))]
    full = [*packer.add(piece(5, 9))]  # fits none: tops up the fullest
    assert [(p.doc_id, len(p)) for p in full[0]] == [(4, 8), (5, 2)]


def test_token_files_round_trip(spark, odd, empty, odd_rows, byte_bpe, ids_of, tmp_path):
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for i, t, *_ in ordered:
        ids = np.append(ids_of(t), 2).astype("<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    for n in (1, 5):
        place = f"file://{tmp_path}/{n}"
        shards = token_files.write_token_files(odd, place, byte_bpe, partitions=n)
        rows = token_files.read_token_files(spark, place, shards).select("doc_id", "start", "n_tokens", F.crc32("ids"))
        assert sorted(map(tuple, rows.collect()), key=lambda r: r[1]) == want
    shards = token_files.write_token_files(empty, f"file://{tmp_path}/none", byte_bpe)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none", shards).count() == 0


def test_registered_token_queries_equal_the_library(spark, folder, ids_of):
    """The digests that op1, op2, op7 and op9 derive, row by row."""
    import hashlib
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from stayline.llm import queries

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = {i: ids_of(t).tobytes() for i, t in texts.items()}
    crc = lambda raw: zlib.crc32(raw)

    pieces = queries.op1_packing(spark, folder).collect()
    one = np.array([1], "<u4").tobytes()
    by_sequence = {}
    for r in pieces:
        whole = ids[r.doc_id] + one
        assert r.doc_tokens == len(whole) // 4 and r.ids_crc32 == crc(whole[4 * r.start:4 * (r.start + r.length)])
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in pieces) == sum(len(x) // 4 + 1 for x in ids.values())
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0

    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    word.no_truncation()
    word.no_padding()
    for r in queries.op2_bpe(spark, folder).collect():
        own = word.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(own) and r.ids_sha256 == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(word.decode(own, skip_special_tokens=False).encode()).hexdigest()

    start, two = 0, np.array([2], "<u4").tobytes()
    for r in queries.op7_token_files(spark, folder).orderBy("doc_id").collect():
        whole = ids[r.doc_id] + two
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(whole) // 4, crc(whole))
        start += len(whole) // 4

    for r in queries.op9_token_counts(spark, folder).collect():
        n = len(ids[r.doc_id]) // 4
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_one_key_for_half_of_the_rows_is_spread(spark, byte_bpe, ids_of, tmp_path):
    rows = [(5, f"same key {i}") for i in range(300)] + [(i, f"own {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    place = "file://" + str(tmp_path)
    shards = token_files.write_token_files(docs, place, byte_bpe, partitions=6)
    found = token_files.read_token_files(spark, place, shards, token_files.id_type(byte_bpe, 2)).orderBy("start").collect()
    assert max(r.docs for r in shards.collect()) < 250
    assert [r.doc_id for r in found] == sorted(i for i, _ in rows)
    two, at = np.array([2], "<u4").tobytes(), 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == Counter((i, ids_of(t).tobytes() + two) for i, t in rows)
