import hashlib

import zstandard

from skein.llm import warc as W


def test_records_and_bundles(tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FRAME_BYTES", 2000)
    b = W.Bundle(f"file://{tmp_path}", 3)
    sent, places = {}, []
    for i in range(40):
        payload = f"<p>{i}\r\n\r\n</p>".encode() * (i + 1)
        raw = W.record(i, None if i == 3 else f"http://x.org/{i}?é\r\nWARC-Type: evil", payload, hashlib.sha256(payload).hexdigest(), len(payload), 1, i % 5 != 4, "1970-01-01T00:00:00Z")
        sent[i] = raw, payload
        places += b.add(i, raw)
    places += b.close()
    assert [p[0] for p in places] == list(range(40))
    with W.opened(b.path)[0].open_input_file(W.opened(b.path)[1]) as f:
        frames = W.seek_table(f, f.size())
        assert len(frames) > 3 and {(p[2], p[3]) for p in places} == {(a, n) for a, n, _ in frames}
        whole = b""
        for at, packed, size in frames:
            part = zstandard.ZstdDecompressor().decompress(f.read_at(packed, at))
            assert len(part) == size
            whole += part
        assert whole == b"".join(raw for raw, _ in sent.values())
        # any Zstandard reader takes the bundle as one stream
        assert zstandard.ZstdDecompressor().stream_reader(f.read_at(f.size(), 0), read_across_frames=True).read() == whole
        for page, _, frame, packed, at, n in places[::-1]:
            one = W.parse(zstandard.ZstdDecompressor().decompress(f.read_at(packed, frame))[at:at + n])
            assert one["WARC-Record-ID"] == f"<urn:page:{page}>" and one["WARC-Type"] == ("revisit" if page % 5 == 4 else "response")
            assert one["payload"] == (None if page % 5 == 4 else sent[page][1]) and ("WARC-Target-URI" in one) == (page != 3)


def test_operator(spark, monkeypatch):
    big, hot, nul = "x" * 99 + "é", "<p>hot</p>" * 20, "only null ids " * 10
    rows = [(1, "u", big), (2, "u", big), (3, None, None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", big), (None, "n", nul), (None, "n", nul),
            (1, "u", big), (7, "http://a\nb", "x" * 100), (8, "u", "x" * 100), (9, "u", "L" * 300_000)]
    rows += [(100 + i, "h", hot) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'a' AS digest", "1 AS first", "2 AS page")
    for share in (1, 3, 10 ** 9):
        monkeypatch.setattr(W, "HOT", share)
        got = W.read_records(W.write_bundles(df.repartition(3)))
        out = sorted(((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=repr)
        first = {}
        for p, _, h in rows:
            if p is not None:
                first[h] = min(first.get(h, p), p)
        want = []
        for p, _, h in rows:
            raw = (h or "").encode()
            again = len(raw) >= 100 and h in first and first[h] != p
            want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
        assert out == sorted(want, key=repr)
        assert {bytes(r.payload).decode() for r in got.where("payload IS NOT NULL").collect()} == {h or "" for _, _, h in rows}
    assert W.read_records(W.write_bundles(df.limit(0))).count() == 0
