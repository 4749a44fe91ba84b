"""The split reader of dumps against a plain XML parser."""

import bz2
import gzip
import random
import string
import xml.etree.ElementTree as ET
from collections import Counter
from datetime import datetime, timezone
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import dumps, readers


def revision(rng, number, size):
    parts = [f"<id>{number}</id>"]
    if rng.random() < 0.8:
        parts.append(f"<parentid>{number - 1}</parentid>")
    parts.append("<timestamp>%s</timestamp>" % rng.choice(["2001-02-03T04:05:06Z", "2020-12-31T23:59:59Z", "no time"]))
    parts.append(
        rng.choice(
            [
                "<contributor><username>A &amp; B</username><id>77</id></contributor>",
                "<contributor>\n  <ip>1.2.3.4</ip>\n </contributor>",
                '<contributor deleted="deleted" />',
            ]
        )
    )
    parts.append(rng.choice(["<comment>c &lt;page&gt; &amp;amp; d</comment>", '<comment deleted="deleted" />', "", "<comment></comment>"]))
    body = escape("".join(rng.choice(string.ascii_letters + " \n<>&é漢") for _ in range(rng.randrange(size))))
    parts.append(rng.choice([f'<text bytes="9" xml:space="preserve">{body}</text>'] * 5 + ['<text bytes="0" />']))
    return "<revision>\n  " + "\n  ".join(parts) + "\n</revision>"


def dump(seed, pages, size):
    """Pages of 0 to many revisions; one holds more than all others together."""
    rng, number, out = random.Random(seed), 0, ["<mediawiki>\n<siteinfo><id>5</id></siteinfo>\n"]
    for p in range(pages):
        out.append(f"<page>\n<title>Title {p} &amp; more</title>\n<ns>0</ns><id>{1000 + p}</id>\n")
        for _ in range(12 * pages if p == 2 else rng.choice([0, 0, 1, 2, 9])):
            number += 1
            out.append(revision(rng, number, size) + "\n")
        out.append("</page>\n")
    return "".join(out) + "</mediawiki>\n"


def plain(text):
    """Every revision as a tuple, by the standard library's parser."""
    out = []
    for page in ET.fromstring(text).iter("page"):
        for k, r in enumerate(page.findall("revision")):
            get = lambda path, r=r: r.findtext(path)
            try:
                when = datetime.strptime(get("timestamp"), "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp()
            except ValueError:
                when = None
            number = lambda x: None if x is None else int(x)
            comment, body = r.find("comment"), r.find("text")
            own = lambda e: None if e is None or e.attrib.get("deleted") or e.attrib.get("bytes") == "0" else e.text or ""
            out.append(
                (
                    int(page.findtext("id")),
                    page.findtext("title"),
                    int(get("id")),
                    number(get("parentid")),
                    k,
                    when,
                    get("contributor/username"),
                    number(get("contributor/id")),
                    get("contributor/ip"),
                    own(comment),
                    own(body),
                )
            )
    return Counter(out)


def read(spark, path):
    rows = dumps.read_revisions(spark, path)
    return rows.withColumn("timestamp", F.unix_seconds("timestamp").cast("double"))


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("seed", range(3))
def test_plain_dump_in_many_splits(spark, tmp_path, small_splits, seed):
    text = dump(seed, 8, 2500)
    (tmp_path / "d.xml").write_text(text)
    got = read(spark, str(tmp_path / "d.xml"))
    assert Counter(tuple(r) for r in got.collect()) == plain(text)
    splits = dumps.pieces(spark, str(tmp_path / "d.xml")).select("block").distinct().count()
    assert splits >= 5


def test_bzip2_page_over_five_splits(spark, tmp_path, small_splits):
    """One page spans most of a bzip2 file that is read in five splits or more;
    a second and a gzip file beside it keep their own state."""
    text, other, third = dump(5, 12, 9000), dump(6, 4, 400), dump(7, 3, 400)
    (tmp_path / "a.xml.bz2").write_bytes(bz2.compress(text.encode(), 1))
    (tmp_path / "b.xml").write_text(other)
    (tmp_path / "c.xml.gz").write_bytes(gzip.compress(third.encode()))
    found = dumps.pieces(spark, str(tmp_path))
    hot = found.filter(F.endswith("file", F.lit("a.xml.bz2"))).filter("_rev").select("block").distinct().count()
    assert hot >= 5
    assert Counter(tuple(r) for r in read(spark, str(tmp_path)).collect()) == plain(text) + plain(other) + plain(third)
    assert readers.read_revisions(spark, str(tmp_path), spread=7).rdd.getNumPartitions() == 7


def test_states_are_one_row_per_split(spark, tmp_path, small_splits):
    (tmp_path / "d.xml").write_text(dump(1, 8, 2500))
    found = dumps.pieces(spark, str(tmp_path))
    assert dumps.states(found).count() == found.select("file", "block").distinct().count()


def test_no_raw_text_is_shuffled(spark, tmp_path):
    (tmp_path / "d.xml").write_text(dump(1, 3, 50))
    plan = dumps.read_revisions(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan
    executed = dumps.read_revisions(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    above = executed.split("MapInArrow")[1].split("BroadcastExchange")[0]
    assert "Exchange" not in above and "Sort" not in above


def test_odd_files(spark, tmp_path):
    cases = {"empty.xml": "", "none.xml": "<mediawiki></mediawiki>", "bare.xml": "<revision><id>3</id></revision><revision><id>4</id></revision>"}
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
    rows = sorted((r.rev_id, r.rev_ord, r.page_id, r.page_title, r.text) for r in dumps.read_revisions(spark, str(tmp_path)).collect())
    assert rows == [(3, 0, None, None, None), (4, 1, None, None, None)]
