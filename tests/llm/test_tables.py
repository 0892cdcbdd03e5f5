"""Components, embeddings and WARC records."""

from __future__ import annotations

import numpy as np
import pytest

from tracewell.llm import embedding_dedup, warc
from tracewell.llm.graph import components


@pytest.mark.parametrize("shape", ["path", "star", "random", "odd"])
def test_components(spark, shape):
    rng = np.random.default_rng(1)
    edges = {
        "path": [(i, i + 1) for i in rng.permutation(200).tolist()],
        "star": [(7, i) for i in range(8, 600)],
        "random": rng.integers(0, 300, (200, 2)).tolist(),
        "odd": [(1, 1), (None, 2), (3, 4), (4, 3), (3, 4)],
    }[shape]
    label = {v: v for e in edges for v in e if None not in e and e[0] != e[1]}
    for _ in range(len(label)):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame([tuple(e) for e in edges], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == label


def brute(rows, cosine=0.9):
    unit = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, float)
            a /= np.abs(a).max()
            unit[k] = a / np.linalg.norm(a)
    near = {k: [j for j in unit if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= cosine] for k in unit}
    label = {k: rows[k][0] for k in range(len(rows))}
    for _ in rows:
        for k in near:
            label[k] = min([label[k], *(label[j] for j in near[k])])
    return sorted((rows[k][0] or -1, len(near.get(k, [])), label[k] or -1) for k in range(len(rows)))


def test_embeddings_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(30):
        base = rng.normal(size=12)
        rows += [(len(rows) + k, (base + rng.normal(size=12) * 0.05).tolist()) for k in range(rng.integers(1, 5))]
    hot = rng.normal(size=12)
    rows += [(1000 + k, (hot + rng.normal(size=12) * 0.01).tolist()) for k in range(60)]
    rows += [(2000 + k, hot.tolist()) for k in range(20)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 12), (3003, [float("nan")] * 12), (3004, [None] * 12), (3005, [1e-300] * 12), (3006, [1e300] * 12), (3007, [1.0, 2.0]), (3008, [1.0, 2.0]), (None, hot.tolist())]
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n_links int").repartition(4)
    got = embedding_dedup.link_vectors(docs).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.link_vectors(none).count() == 0


def test_tables_follow_the_number_of_vectors():
    small, large = embedding_dedup.plan_tables(1_000), embedding_dedup.plan_tables(1_000_000_000)
    assert small[0] < large[0] and small[1] < large[1]
    for bits, tables in (small, large):
        agree = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - agree) ** tables >= 0.98


def test_warc_records(spark, tmp_path):
    html = '<html><title>T &amp;lt; x</title><script>var a="<p>no</p>";</script><!-- gone --><p>One&nbsp;two<br>three &#233;&#x1F642;&#0;</p><A class=b href="/x">link</A><a href=\'/y?a="b"\' ><a\tid=q href = /z/><style>p{}'
    rows = [
        ("<urn:a>", "http://h/1", "2021-05-05T00:00:00Z", "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX: y\r\n\r\n", html, 1),
        ("<urn:b>", None, None, "HTTP/1.1 200 OK\r\ncontent-type: image/png\r\n\r\n", "png", 2),
        ("<urn:c>", "http://h/3", None, "HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n", "a <b> c", 3),
        (None, None, None, None, None, None),
    ]
    responses = spark.createDataFrame(rows, "record_id string, target_uri string, date string, http_header string, payload string, block int")
    out = warc.derive(responses).collect()
    text = {r.refers_to: r.block for r in out if r.warc_type == "conversion"}
    assert text["<urn:a>"] == "T &lt; x\nOne two\nthree é🙂�\nlink" and text["<urn:c>"] == "a <b> c" and "<urn:b>" not in text
    meta = {r.refers_to: r for r in out if r.warc_type == "metadata"}
    assert len(meta) == 4
    assert "source-http-header: X: y\r\n" in meta["<urn:a>"].block and "outlink: /x\r\noutlink: /y?a=\"b\"\r\noutlink: /z/\r\n" in meta["<urn:a>"].block
    conversion = next(r for r in out if r.warc_type == "conversion" and r.refers_to == "<urn:a>")
    assert f"conversion-record-id: {conversion.record_id}\r\n" in meta["<urn:a>"].block
    assert "WARC-Target-URI" not in meta["<urn:b>"].header and "WARC-Refers-To: <urn:b>" in meta["<urn:b>"].header
    assert all(r.content_length == len(r.block.encode()) for r in out)
    warc.write_warc(warc.derive(responses).coalesce(1), str(tmp_path / "w"))
    written = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    at, n = 0, 0
    while at < len(written):
        head, _, rest = written[at:].partition(b"\r\n\r\n")
        size = int(head.rpartition(b"Content-Length: ")[2])
        assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
        at, n = at + len(head) + 4 + size + 4, n + 1
    assert n == len(out)
    assert warc.derive(responses.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (None, "http://u", "<p>x")], "page_id long, url string, html string")
    assert warc.derive(warc.page_responses(pages)).count() == 4
