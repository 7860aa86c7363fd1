import hashlib
import random

import pytest

from arealith.llm.warc import warc_report

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def expected(pages):
    last = {}
    for i, _, html in pages:
        html = html or ""
        if len(html.encode()) >= 1000 and i is not None:
            last[html] = max(last.get(html, i), i)
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        again = html in last and last[html] != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[html] if again else None))
    return sorted(map(str, out))


def pages():
    rng = random.Random(4)
    long = "<p>" + "ä word " * 300
    rows = [(1, "http://a/", FAKE), (2, None, None), (3, "bad\r\nX-Evil: 1\r\n\r\n", ""), (4, "u", long), (5, "u", long), (9, "u", long), (6, "u", "WARC/1.1\r\n"), (7, "u", FAKE * 40), (8, "u", "x" * 3000 + FAKE + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 999999\r\n\r\n" + "y" * 3000)]
    rows += [(i, f"http://h/{i}", "".join(rng.choice(["a", "WARC/1.1\r\n", "\r\n\r\n", FAKE, "é", " "]) for _ in range(rng.randrange(60)))) for i in range(20, 80)]
    return rows


@pytest.mark.parametrize("split", ["700", "4m"])
def test_magic_in_payloads_and_revisits(spark, tmp_path, split):
    rows = pages()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
        got = warc_report(df, str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(str(tuple(r)) for r in got) == expected(rows)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_report(df, str(tmp_path / "w")).count() == 0
