"""Personal data against the plain patterns, and what the trees add."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from twinline.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def plain(text: str | None) -> str:
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                kind == "email"
                or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)
                or kind == "phone" and 8 <= len(digits) <= 15
            ):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def spans(spark, texts: list) -> list[tuple]:
    rows = [(i if i % 5 else None, t, "clash") for i, t in enumerate(texts)] + [(3, texts[0], "again")]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(4)
    found = pii.detect(table).select("doc_id", pii.span_text(F.col("base")), pii.span_text(F.col("spans")))
    return [tuple(r) for r in found.collect()]


def test_base_findings_equal_the_plain_patterns(spark):
    r = random.Random(4)
    parts = [
        "a", "@", "b.c", "-", ".", "1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (301) 555-0346", "+", "  ", "\n",
        "999.1.1.1", "10.0.0.255", "x@y.zz", "_z", "é", "\U0001F600", " ", "(", ")", "\x01", "0", "5", "$1", "\\",
    ]
    texts = [
        None, "", "a@b.com_x@d.org", "1.2.3.4.5.6.7.8", "1" * 20000, "1 " * 20000, "a." * 20000, "a@b" + ".c" * 20000, "+1" * 9000,
        "256.1.1.1", "00000000000000000001.2.3.4", "99999999999999999999.2.3.4",
    ]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(600)]
    got = spans(spark, texts)
    want = [(i if i % 5 else None, plain(t)) for i, t in enumerate(texts)] + [(3, plain(texts[0]))]
    assert sorted((x[:2] for x in got), key=str) == sorted(want, key=str)
    assert all(set(b.split(",")) - {""} <= set(s.split(",")) for _, b, s in got)


def test_no_rows(spark):
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trees_add_other_spellings_and_leave_numbers(spark):
    r = random.Random(1)
    word = lambda: r.choice(["anha", "the", "rely", "of"])
    number = lambda: f"({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
    known = [f"{word()} call +1 {number()} {word()}" for _ in range(300)]
    mails = [f"{word()} mail {word()}.{r.randint(10, 99)}@mail{i % 9}.example.com {word()}" for i in range(300)]
    plain_numbers = [f'{word()} key = "{r.randint(10**8, 10**9)}" {word()}' for _ in range(300)]
    spelt = ["the mail rely.42 [at] mail3 [dot] example [dot] com of", "of call 1 (301) 555-0346 the", 'of key = "123456789" the']
    got = {s for _, b, s in spans(spark, known + mails + plain_numbers + spelt) if not b}
    assert got == {"", "email:9:51", "phone:8:24"}


def test_threshold_needs_its_own_cells_to_be_good():
    cell = lambda v, n, pos: dict(zip(pii.FEATURES, [v, 0, 0, 0, 0, 0, 0])) | {"n": n, "pos": pos}
    cells = [cell(0, 1000, 1000), cell(1, 20, 0), cell(2, 500, 20)]
    model = pii.boost([dict(c) for c in cells])
    threshold = pii.calibrate(model, cells, 0.9)
    assert [model.of(c) >= threshold for c in cells] == [True, False, False]
    assert pii.calibrate(model, [cell(0, 3, 3)], 0.9) == float("inf")  # too few to tell


def test_redaction(spark):
    rows = [(1, "mail a.b@c.de or 10.0.0.1 now"), (2, None), (3, "")]
    got = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, "mail [email] or [ip] now"), (2, None), (3, "")]


def test_query_counts_and_digest_equal_the_plain_patterns(spark, tmp_path):
    texts = [
        None, "", "a@b.cc", "10.0.0.1 and 10.0.0.2", "4111 1111 1111 1111", "+1 (301) 555-0346", "+44 20 7946 0958, 1.2.3.4, x@y.zz, 8.8.8.8",
        "4111-1111-1111-1111 a@b.cc 4111111111111111 c@d.ee f@g.hh",
    ]
    rows = [(i if i % 4 else None, t, "en", "s", 0) for i, t in enumerate(texts)] + [(2, texts[3], "en", "s", 0)]
    spark.createDataFrame(rows, queries.DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_pii(spark, str(tmp_path)).select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256").collect()
    want = []
    for doc_id, text, *_ in rows:
        base = plain(text)
        kinds = [s.split(":")[0] for s in base.split(",")]
        want.append((doc_id, *[kinds.count(k) for k in pii.KINDS], hashlib.sha256(base.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
