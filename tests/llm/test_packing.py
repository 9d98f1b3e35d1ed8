"""Packing: exact coverage, gapless sequences, and few of them."""

import zlib
from collections import Counter

import numpy as np
import samples

from tuneprep.llm.packing import pack, plan_bins
from tuneprep.llm.tokens import TextEncoder


def test_pack(spark):
    rows = [(k, t) for k, t, _ in samples.documents()] + [(k and k + 10**6, t) for k, t in samples.ROWS]
    got = pack(samples.table(spark, rows)).collect()
    tokenizer = TextEncoder().tokenizer
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
           for k, t in rows if k is not None}
    bins, covered = {}, Counter()
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            part = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == r["ids_crc32"]
            covered[r["doc_id"]] += r["length"]
            assert r["length"] == 2048 or r["piece"] == 0
    times = Counter(k for k, _ in rows)
    assert covered == {k: len(v) * times[k] for k, v in ids.items()}
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(samples.table(spark, [])).count() == 0


def test_bins_use_every_piece_and_beat_best_fit():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(5.5, 1.2, 20_000).astype(int) + 1, 2048)
    counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    bins, used = plan_bins(counts, 2048), Counter()
    for times, chosen in bins:
        assert sum(chosen) <= 2048 and times > 0
        used.update({n: times * k for n, k in Counter(chosen).items()})
    assert used == counts
    gaps = np.zeros(2049, int)                      # best fit, longest first
    for n in sorted(lengths, reverse=True):
        fit = np.flatnonzero(gaps[n:]) if gaps[n:].any() else []
        gap = n + fit[0] if len(fit) else 2048
        gaps[gap] -= gap != 2048 or gaps[2048] > 0
        gaps[gap - n] += 1
    assert sum(t for t, _ in bins) <= gaps.sum()


def test_encoder_gives_the_ids_of_the_tokenizer():
    encoder = TextEncoder()
    marks = [c for c in map(chr, range(1, 0x30000, 3)) if not 0xD800 <= ord(c) < 0xE000]
    texts = ["", " a", "a  b", "it's\n\nso ", "x\ty z", "<|endoftext|> q", "a\0b c", "\n\nq w",
             "don't we've  1234 ok.", "y" * 20_000, *[f"a{c}1 {c}{c} {c}b'{c}s" for c in marks]]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == want
