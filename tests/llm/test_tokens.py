import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from touchline.llm import packing, tokens

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def whole(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab Zé'\n\t\ŕ\u0085 \x1c\x0b.1!sİ<|>", max_size=40))
def test_pieces_encode_like_whole_texts(text):
    for path, cuts in ((WORD, "words"), (BYTE, "bytes")):
        assert tokens.encoder(path, cuts).encode([text])[0].tolist() == whole(path, text)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 65_536, 65_537, 200_000])
def test_segment_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 49_000).astype(np.uint32)
    assert np.array_equal(tokens.decode_segment(tokens.encode_segment(ids)), ids)


def test_segment_of_one_symbol_and_damage():
    data = tokens.encode_segment(np.full(1000, 7, np.uint32))
    assert tokens.decode_segment(data).tolist() == [7] * 1000
    data = bytearray(tokens.encode_segment(np.arange(5000, dtype=np.uint32)))
    data[-2000] ^= 1
    with pytest.raises(ValueError):
        tokens.decode_segment(bytes(data))
    with pytest.raises(ValueError):
        tokens.decode_segment(b"nothing of this kind")


def test_token_files(notes_df, no_notes, note_rows):
    got = tokens.token_files(notes_df, WORD, segment_ids=50).collect()
    want, start = [], 0
    for key, note in sorted(note_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = whole(WORD, note) + [1]
        want.append((key, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokens.token_files(no_notes, WORD).count() == 0


def test_pack_notes(notes_df, no_notes, note_rows):
    room = 64
    got = packing.pack_notes(notes_df, BYTE, room=room).collect()
    want = Counter()
    for key, note in note_rows:
        ids = whole(BYTE, note) + [0]
        at = [0, *range(len(ids) % room or room, len(ids) + 1, room)]
        want.update((key, i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(at, at[1:])))
    assert Counter((r.event_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= room
    assert packing.pack_notes(no_notes, BYTE).count() == 0


def unrolled(lengths, room):
    """Best-two-fit a run at a time."""
    left = sorted(lengths, reverse=True)
    bins = []
    while left:
        own, gap = [], room
        while True:
            fit = next((x for x in left if x <= gap), None)
            if not fit:
                break
            own.append(fit), left.remove(fit)
            gap -= fit
        if gap:
            best = max(((a + b, max(a, b)) for i, a in enumerate(left) for b in left[i + 1:]
                        if own[-1] < a + b <= gap + own[-1]), default=None)
            if best:
                pair = [best[1], best[0] - best[1]]
                left.append(own.pop())
                for x in pair:
                    left.remove(x)
                own += pair
                left.sort(reverse=True)
        bins.append(sorted(own))
    return bins


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_is_the_unrolled_rule(lengths):
    plan = packing.plan_best_two_fit(Counter(lengths), 30)
    assert sorted(sorted(own) for often, own in plan for _ in range(often)) == sorted(unrolled(lengths, 30))


def test_plan_stays_small_for_many_runs():
    counts = {n: 10_000_000 + n * 37 for n in range(1, 2049)}
    plan = packing.plan_best_two_fit(counts, 2048)
    assert sum(often * len(own) for often, own in plan) == sum(counts.values()) and len(plan) < 3 * 2048


def test_a_range_reads_only_its_blocks():
    from touchline.llm.tokens import BLOCK, decode_segment, encode_segment
    ids = np.random.default_rng(2).integers(0, 3000, 3 * BLOCK + 777).astype(np.uint32)
    data = encode_segment(ids)
    for start, stop in ((0, 10), (BLOCK - 3, BLOCK + 3), (2 * BLOCK + 5, 3 * BLOCK + 100), (3 * BLOCK, None), (5, 5), (10**9, None), (0, None)):
        assert (decode_segment(data, start, stop) == ids[start:stop]).all()
    at = data.index(np.uint64(BLOCK).astype("<u8").tobytes(), 24)  # the second block's head
    broken = bytearray(data)
    broken[at + 20 + 8 * 256 + 40] ^= 255  # in its words
    with pytest.raises(ValueError):
        decode_segment(bytes(broken))
    assert (decode_segment(bytes(broken), 0, BLOCK) == ids[:BLOCK]).all() and (decode_segment(bytes(broken), 2 * BLOCK) == ids[2 * BLOCK:]).all()
    assert not len(decode_segment(encode_segment(ids[:0])))


def test_letters_are_encoded_by_merges_alone(monkeypatch):
    letters = [chr(c) for c in range(256) if chr(c).isalpha() and chr(c) not in "\u00aa\u00b5\u00ba"]
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    words = [a + b + "tz" for a in letters for b in letters] + [a + b + m for a in "bZ\u00e9\u00df" for b in marks for m in ("", "'", "***")]
    coder = tokens.PieceEncoder(WORD, "words")
    seen = []

    class Watched:
        model = coder.tokenizer.model

        def encode(self, text, **options):
            seen.append(text)
            return full.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return full.encode_batch_fast(texts, **options)

    full, coder.tokenizer = coder.tokenizer, Watched()
    assert coder.encode([" ".join(words)])[0].tolist() == whole(WORD, " ".join(words))
    assert not any(c.isalpha() for text in seen for c in text) and len(seen) <= 3 * len(marks)


def test_a_vocabulary_with_other_rules_keeps_them():
    from tokenizers import Regex, normalizers, pre_tokenizers
    tokenizer = Tokenizer.from_file(WORD)
    assert tokens._plain(tokenizer)
    assert not tokens._plain(Tokenizer.from_file(BYTE))
    tokenizer.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.StripAccents(), normalizers.Lowercase()])
    assert not tokens._plain(tokenizer)
    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.add_tokens(["goal"])
    assert not tokens._plain(tokenizer)
    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex("x"), "isolated")
    assert not tokens._plain(tokenizer)
