"""Content of any depth against a walk in plain Python."""

import base64
import hashlib
import json
import random
import struct

from pyspark.sql import functions as F

from skein.functions import images
from skein.sources import transcripts as T


def walked(content):
    parts, calls, results = [], [], []

    def text_below(c):
        if isinstance(c, str):
            return c.strip()
        if isinstance(c, list):
            return "\n".join(x for x in (i if isinstance(i, str) else i.get("text", "") if isinstance(i, dict) else "" for i in c) if x).strip()
        return ""

    def go(c):
        if isinstance(c, str):
            parts.append(c)
        elif isinstance(c, list):
            for x in c:
                go(x)
        elif isinstance(c, dict):
            kind = c.get("type", "")
            if kind in ("tool_use", "toolCall"):
                calls.append((c.get("id", ""), c.get("name", ""), len(calls)))
            elif kind in ("tool_result", "toolResult"):
                if "content" in c:
                    go(c["content"])
                results.append((c.get("tool_use_id", ""), text_below(c.get("content")), len(results)))
            elif kind not in ("image", "image_url"):
                parts.append(c.get("text", ""))
    go(content)
    return "\n".join(p for p in parts if p).strip(), calls, results


def made(rng, depth):
    kind = rng.randrange(8) if depth else rng.randrange(4)
    if kind == 0:
        return rng.choice(["", "plain", "with [brackets] and \"content\" in it", " spaced "])
    if kind == 1:
        return {"type": rng.choice(["text", "other", "image"]), "text": f"t{rng.randrange(99)}"}
    if kind == 2:
        return {"type": "tool_use", "id": f"c{rng.randrange(9)}", "name": "Shell", "input": {"command": "ls", "content": ["x"]}}
    if kind == 3:
        return rng.choice([3, True, None, {}])
    if kind in (4, 5):
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {"type": rng.choice(["tool_result", "toolResult"]), "tool_use_id": f"c{rng.randrange(9)}"} | ({"content": made(rng, depth - 1)} if rng.random() < 0.9 else {})


def test_content_of_any_depth(spark):
    rng = random.Random(8)
    shapes = [[made(rng, 6) for _ in range(3)] for _ in range(150)] + ["text", "", [], {}, {"type": "tool_result", "content": {"type": "text", "text": "in an object"}}]
    deep = "bottom"
    for i in range(60):
        deep = [deep] if i % 2 else {"type": "tool_result", "tool_use_id": f"d{i}", "content": [f"level {i}", deep]}
    shapes.append(deep)
    rows = [(i, json.dumps({"c": s})) for i, s in enumerate(shapes)]
    df = spark.createDataFrame(rows, "id int, raw string").withColumn("items", T.content_items(F.try_variant_get(F.try_parse_json("raw"), "$.c", "variant")))
    got = df.select("id", T.items_text(F.col("items")).alias("t"), T.items_calls(F.col("items")).alias("c"), T.items_results(F.col("items")).alias("r")).orderBy("id").collect()
    for shape, row in zip(shapes, got, strict=True):
        text, calls, results = walked(shape)
        assert row.t == text.strip(" ") or row.t == text, shape
        assert [(c.id, c.tool_name, c.ordinal) for c in row.c] == calls, shape
        assert [(r.for_id, r.outcome_text, r.ordinal) for r in row.r] == results, shape


def test_sizes_of_images(spark):
    png = lambda w, h: b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x06"
    gif = lambda w, h: b"GIF89a" + struct.pack("<HH", w, h) + b"\0"
    segment = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    frame = lambda mark, w, h: segment(mark, b"\x08" + struct.pack(">HH", h, w) + b"\x01")
    start = b"\xff\xd8"
    cases = [(png(70000, 3), (70000, 3)), (png(1, 2)[:20], (1, 0)), (gif(513, 2), (513, 2)), (start + segment(0xE0, b"x" * 300) + frame(0xC0, 640, 480), (640, 480)),
             (start + segment(0xE1, b"\xff\xc0" * 40) + b"\xff\xff" + segment(0xC4, b"t")[0:] + frame(0xC2, 5, 6), (5, 6)), (start + segment(0xDA, b"s") + frame(0xC0, 1, 1), (0, 0)), (start + segment(0xE0, b"cut")[:-2], (0, 0)),
             (start + b"\xff\xd0" + frame(0xC1, 9, 8), (9, 8)), (b"RIFF1234WEBPVP8 ", (0, 0)), (b"", (0, 0)), (b"\xff\xd8\xff", (0, 0)), (start + b"no", (0, 0))]
    df = spark.createDataFrame([(i, bytearray(raw)) for i, (raw, _) in enumerate(cases)] + [(99, None)], "id int, data binary")
    got = {r.id: tuple(r.d) for r in df.select("id", images.dimensions(F.col("data")).alias("d")).collect()}
    assert got == {i: size for i, (_, size) in enumerate(cases)} | {99: (0, 0)}


def test_assets(spark):
    raw = b"GIF87a" + struct.pack("<HH", 7, 9)
    data = base64.b64encode(raw).decode()
    content = ["x", {"type": "image", "source": {"media_type": "image/gif", "data": data}}, {"type": "tool_result", "content": [{"type": "text", "text": "t"}, {"type": "image", "mimeType": "image/gif", "data": data}]},
               {"type": "image_url", "url": "https://example.test/a.png"}, {"type": "note", "source": {"media_type": "image/png"}}, {"type": "image", "data": "%%%"}, {"type": "text", "source": {"data": data}}]
    lines = spark.createDataFrame([("p", "s", False, 1, json.dumps({"type": "user", "uuid": "u", "message": {"role": "user", "content": content}}))], "path string, source_session_id string, is_subagent boolean, line_no int, raw string")
    got = T.generic_entries(lines).first().assets
    assert [(a.content_index, a.prompt_order, a.mime_type, a.bytes, a.width, a.height) for a in got] == [
        (1, 0, "image/gif", 10, 7, 9), (1, 1, "image/gif", 10, 7, 9), (3, 2, "application/octet-stream", 0, 0, 0), (4, 3, "image/png", 0, 0, 0), (5, 4, "application/octet-stream", 0, 0, 0)]
    assert got[0].asset_sha256 == got[1].asset_sha256 == hashlib.sha256(raw).hexdigest() and got[2].raw_ref == "https://example.test/a.png" and got[2].asset_sha256 == hashlib.sha256(got[2].raw_ref.encode()).hexdigest()
