"""Base spans against Python's regular expressions; added spans stay apart from them."""

import hashlib
import re

import samples
from pyspark.sql import functions as F

from tuneprep.llm.pii import PiiOptions, find_pii, pii_report, redact, scan, scored

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AWKWARD = [
    (101, "a@b.c_d@e.f x@y. .@-.- q@w.e@r.t 1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255 256.1.1.1"),
    (102, "4111 1111 1111 1111, 4111-1111-1111-1112 and 1 2 3 4  5 +49 (30) 1234-567)) +1"),
    (103, "é😀 me@x.org +4930123456789012345 " + "1 2 3 " * 4000 + "0000000000000"),
    (104, "a" * 30_000 + "@" + "b." * 3_000 + "." + "7" * 20_000),
]


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def expected(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "")
            if len(m[0]) < 4000 and valid(k, m[0]) or len(m[0]) >= 4000 and k == "email"]


def test_base_spans(spark):
    rows = [(k, t) for k, t, _ in samples.documents()] + samples.ROWS + AWKWARD
    want = []
    for k, text in rows:
        spans = expected(text)
        digest = hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in spans).encode()).hexdigest()
        want.append((k, *[sum(s[0] == kind for s in spans) for kind in PATTERNS], digest))
    got = pii_report(samples.table(spark, rows)).collect()
    names = ["doc_id", *[f"n_{k}" for k in PATTERNS], "base_sha256"]
    assert samples.by_row(got, names) == sorted(want, key=repr)


def test_trees_add_candidates_that_look_like_base_spans(spark):
    rows = [(i, f"please mail to user{i}@host{i % 7}.example.org today, {i} times or "
                f"call {i % 10}{i % 7}") for i in range(600)]
    rows += [(1000 + i, f"please mail to user{i} (at) host{i % 7}.example.org today") for i in range(5)]
    rows += [(2000 + i, f"build 20{i:02d} 1234 5678 90 went well") for i in range(60)]
    options = PiiOptions(min_positive=10, min_held_out=10, precision=0.9)
    docs = samples.table(spark, rows)
    assert scored(scan(docs), options) is not None
    got = {r["doc_id"]: r for r in find_pii(docs, options).collect()}
    added = {k: [tuple(s) for s in r["added"]] for k, r in got.items()}
    assert added[1000] == [(0, 15, 43)]
    assert not any(v for k, v in added.items() if k < 1000 or k >= 2000)
    text = {r["doc_id"]: r["text"] for r in redact(docs, options).collect()}
    assert text[3].startswith("please mail to [EMAIL] today") and text[1000] == "please mail to [EMAIL] today"


def test_redaction_and_empty_tables(spark):
    docs = samples.table(spark, samples.ROWS + AWKWARD[:2])
    out = redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = out.where("doc_id = 102").first()["text"]
    assert text == "[CARD], 4111-1111-1111-1112 and 1 2 3 4  5 [PHONE])) +1"
    same = out.where("doc_id < 100 OR doc_id IS NULL")
    assert same.exceptAll(docs.where("doc_id < 100 OR doc_id IS NULL")).count() == 0
    assert pii_report(samples.table(spark, [])).where(F.lit(True)).count() == 0


def test_many_obfuscated_spans_are_added(spark):
    rows = [(i, (f"please mail to user{i}@host{i % 7}.example.org today",
                 f"server ip {i % 200}.{i % 9}.1.{i % 250} is up",
                 f"please call +49 30 {1000000 + 7 * i} today")[i % 3]) for i in range(900)]
    rows += [(1000 + i, f"please mail to user{i} (at) host{i % 7} (dot) org today") for i in range(300)]
    rows += [(2000 + i, f"server ip {i % 200},{i % 9},1,{i % 250} is up") for i in range(300)]
    rows += [(3000 + i, f"please call 0049 30 {1000000 + 7 * i} today") for i in range(300)]
    rows += [(4000 + i, f"lot 7{i:03d} 1234 5679, part 900,{i % 999},777,1 went well") for i in range(300)]
    options = PiiOptions(min_positive=10, min_held_out=10)
    got = {r["doc_id"]: r for r in find_pii(samples.table(spark, rows), options).collect()}
    kinds = {k: [s["kind"] for s in r["added"]] for k, r in got.items()}
    # A number that passes as a card is a base span already.
    missed = {start: [i for i in range(300) if kind not in kinds[start + i] and not got[start + i]["base"]]
              for start, kind in ((1000, 0), (2000, 1), (3000, 3))}
    assert missed == {1000: [], 2000: [], 3000: []}
    assert not any(kinds[4000 + i] for i in range(300))
