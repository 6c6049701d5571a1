"""The worklist of decoded layers against a plain one with a place for every character, and its cost on long texts."""

import base64
import gzip
import random
import re
import resource
import time
import urllib.parse
import zlib

import pytest

from tessera.llm import secrets

PLAIN = re.compile(rb"[\t\n\r -~]{14,}")


def plain_layers(text, place):
    """(decoded text, place of each character) of all that decodes in a text; place: (start, end) in the original."""
    for pattern, decode in ((r"(?:%[0-9A-Fa-f]{2})+", secrets._url), (secrets.UNICODE_ESCAPE.pattern, secrets._unicode)):
        out, at = [], 0
        for m in re.finditer(pattern, text):
            out += [(c, place[i]) for i, c in enumerate(text[at : m.start()], at)]
            out += [(c, (place[a][0], place[z - 1][1])) for c, (a, z) in decode(m)]
            at = m.end()
        if at:
            out += [(c, place[i]) for i, c in enumerate(text[at:], at)]
            yield "".join(c for c, _ in out), [p for _, p in out]
    runs = [m.span() for m in secrets.BASE64_LINES.finditer(text) if m.end() - m.start() > 19]
    runs += [m.span() for m in secrets.BASE64_RUN.finditer(text) if not any(a <= m.start() and m.end() <= z for a, z in runs)]
    for a, z in runs:
        kept = [i for i in range(a, z) if text[i] not in " \t\r\n="]
        for skip in range(4):
            some = kept[skip:]
            some = some[: len(some) - (len(some) % 4 == 1)]
            if len(some) >= 19:
                data = base64.b64decode("".join(text[i] for i in some).replace("-", "+").replace("_", "/") + "=" * (-len(some) % 4))
                yield from plain_bytes(data, [(place[some[k * 8 // 6]][0], place[some[min(len(some), -(-(k + 1) * 8 // 6)) - 1]][1]) for k in range(len(data))], (place[a][0], place[z - 1][1]))
    for m in secrets.HEX_RUN.finditer(text):
        for skip in (0, 1):
            n = (m.end() - m.start() - skip) // 2
            at = m.start() + skip
            yield from plain_bytes(bytes.fromhex(text[at : at + 2 * n]), [(place[at + 2 * k][0], place[at + 2 * k + 1][1]) for k in range(n)], (place[m.start()][0], place[m.end() - 1][1]))


def plain_bytes(data, place, whole):
    try:
        text, at = data.decode(), 0
        if PLAIN.search(data):
            out = []
            for c in text:
                out.append((place[at][0], place[at + len(c.encode()) - 1][1]))
                at += len(c.encode())
            yield text, out
    except UnicodeDecodeError:
        yield from ((m[0].decode(), place[m.start() : m.end()]) for m in PLAIN.finditer(data))
    for k in range(len(data)):
        if secrets.PACKED.match(data, k):
            opener, piece = zlib.decompressobj(47), b""
            try:
                for b in data[k:]:
                    piece += opener.decompress(bytes([b]))
            except zlib.error:
                pass
            yield from plain_bytes(piece, [whole] * len(piece), whole)


def plain_scan(text):
    found, seen, work = set(), set(), [(text, [(i, i + 1) for i in range(len(text))])]
    while work:
        layer, place = work.pop()
        if not layer or (layer, tuple(place)) in seen:
            continue
        seen.add((layer, tuple(place)))
        found |= {(kind, place[a][0], place[z - 1][1]) for kind, a, z in secrets.base_spans(layer)}
        work += plain_layers(layer, place)
    return found


def wrapped(rng, data):
    kind = rng.randrange(8)
    if kind == 0:
        return "".join(f"%{b:02X}" if rng.random() < 0.3 else chr(b) for b in data) if data.isascii() else urllib.parse.quote(data)
    if kind == 1:
        return "".join(f"\\u{b:04x}" if rng.random() < 0.3 else f"\\x{b:02x}" if rng.random() < 0.1 else chr(b) for b in data) if data.isascii() else base64.b64encode(data).decode()
    if kind == 2:
        return base64.b64encode(data).decode()
    if kind == 3:
        return base64.urlsafe_b64encode(data).decode().rstrip("=")
    if kind == 4:
        return base64.encodebytes(data).decode()
    if kind == 5:
        return base64.b64encode(gzip.compress(data, mtime=0)).decode()
    if kind == 6:
        return zlib.compress(data).hex()
    return (rng.randbytes(5) + data + rng.randbytes(5)).hex()


def test_layers_of_random_nested_texts_against_a_plain_worklist():
    rng = random.Random(31)
    for _ in range(500):
        inner = rng.choice(["password=%s", "api_key: '%s'", "AKIA%s", "%s"]) % "".join(rng.choices("ABCDEF0123456789abcdef", k=rng.choice([8, 20, 40])))
        text = inner + rng.choice(["", " naïve é", " tail"])
        for _ in range(rng.randrange(1, 4)):
            text = rng.choice(["", "x ", "see: ", "key_"]) + wrapped(rng, text.encode()) + rng.choice(["", " y", "."])
        _, every, _ = secrets.scan(text)
        assert set(every) == plain_scan(text), text


@pytest.mark.parametrize("name", ["escape", "random run", "zlib marks", "escapes alone"])
def test_long_texts_take_little_time_and_memory(name):
    rng = random.Random(1)
    text = {
        "escape": lambda: "some words that go on, and on. " * 650_000 + "%41 password=abcdefgh%69jk",
        "random run": lambda: "x " + base64.b64encode(rng.randbytes(7_500_000)).decode() + " y",
        "zlib marks": lambda: base64.b64encode(b"\x78\x9c" * 400_000).decode(),
        "escapes alone": lambda: "%41" * 1_000_000,
    }[name]()
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.thread_time()
    _, every, _ = secrets.scan(text)
    assert time.thread_time() - began < 20
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    if name == "escape":
        assert ("assign", len(text) - len("password=abcdefgh%69jk"), len(text)) in every


def test_data_that_unfolds_to_itself_ends():
    member = zlib.compress(b"password=abcdefgh12")
    for _ in range(6):
        member = zlib.compress(member + member)
    _, every, layers = secrets.scan(base64.b64encode(member).decode())
    assert every and layers < 50
