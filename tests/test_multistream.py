"""The splittable dump source: every page once, whatever the ranges, and reads that go on."""

import bz2
import io
import random
from xml.sax.saxutils import escape

import pytest

from heronry.operators.bucketed import BucketTable
from heronry.operators.store import hashing_embedder
from heronry.sources import multistream, readers
from heronry.streaming import ingest


def dump(seed, n, per_stream, path=None):
    """A dump whose streams are cut anywhere: between pages, inside them and inside tags."""
    rng = random.Random(seed)
    page = lambda i: f"<page><title>T &amp; {i}</title><ns>{i % 7 and '0' or '1'}</ns><id>{i}</id>{'<redirect title=\"x\" />' if i % 11 == 0 else ''}<revision><id>9</id><text xml:space=\"preserve\">{escape('Word <b> of ' + str(i) + ' ' + ' '.join(rng.choices(['alpha', 'beta', '<page>', 'é'], k=60)))}</text></revision></page>\n"
    whole = ("<mediawiki>\n<siteinfo>x</siteinfo>\n" + "".join(map(page, range(n))) + "<page><id>bad</page>\n</mediawiki>").encode()
    cuts = sorted(rng.randrange(len(whole)) for _ in range(n // per_stream))
    tag = whole.find(b"<page>", len(whole) // 2)
    cuts = sorted({*cuts, *(tag + k for k in (0, 1, 3, 5, 6))})
    data = b"".join(bz2.compress(whole[a:b], 1) for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True))
    if path:
        with open(path, "wb") as f:
            f.write(data)
    return whole, data


@pytest.mark.parametrize("seed", range(6))
def test_ranges_hold_every_page_once(seed):
    whole, data = dump(seed, 120, 4)
    want = [p + b"</page>" for p in whole.split(b"</page>")[:-1]]
    want = [p[p.index(b"<page>") :] for p in want]
    for each in (len(data), 5000, 700, 37):
        got = [p for a in range(0, len(data), each) for p in multistream.pages(io.BytesIO(data), a, min(a + each, len(data)))]
        assert got == want
    assert multistream.row(b"<page><id>bad</page>") is None


def test_source_equals_read_dump_in_many_tasks(spark, tmp_path):
    path = f"{tmp_path}/d.xml.bz2"
    _, data = dump(9, 300, 3, path)
    pages = multistream.dump_pages(spark, path, bytes=len(data) // 6)
    assert 6 <= pages.rdd.getNumPartitions() <= 7
    shown = lambda df: sorted(map(tuple, df.collect()))
    found, plain = shown(readers.articles(pages)), shown(readers.read_dump(spark, path))
    assert found == plain and len(found) > 200
    with bz2.open(f"{tmp_path}/one.bz2", "wb") as f:
        f.write(b"".join(multistream.pages(io.BytesIO(data), 0, len(data))))
    assert shown(readers.articles(multistream.dump_pages(spark, f"file://{tmp_path}/one.bz2", bytes=1000))) == found


def test_index_dump_goes_on(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/d.xml.bz2"
    _, data = dump(4, 90, 3, path)
    plain, calls = ingest.index_batch, []

    def stopping(*args, **how):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return plain(*args, **how)

    run = lambda: ingest.index_dump(spark, path, f"{tmp_path}/t", f"{tmp_path}/c", step_bytes=len(data) // 3 - 1, embedder=hashing_embedder(4))
    monkeypatch.setattr(ingest, "index_batch", stopping)
    with pytest.raises(KeyboardInterrupt):
        run()
    monkeypatch.setattr(ingest, "index_batch", plain)
    assert run() == 2 and run() == 0
    docs = {r["doc_id"] for r in BucketTable(spark, f"{tmp_path}/t").read().select("doc_id").collect()}
    assert docs == {r["page_id"] for r in readers.read_dump(spark, path).collect()}
