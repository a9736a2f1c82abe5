import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import time
import zlib
from urllib.parse import quote

import pytest

from runmill.llm.secret_scan import BLOCK, base_spans, redact, redact_documents, scan, scan_documents

KEY = "AKIA" + "Q" * 16
ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(text):
    """The base rules, word for word."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@pytest.mark.parametrize(
    "text",
    [
        "", "token=token:abcdefg", "é token = \"abcdef0\" x", "API_KEY:'a.b-c=d' Secret=12345", f"x{KEY}AKIA AKIAAKIA{'0' * 20}",
        "0" * 23 + " " + "a" * 24, "ſecret=abcdefgh", "toKen=abcdefgh", "password" + " " * 50 + "=" + " " * 9 + "longenough", f"token={'f' * 30}", "apikey=x passwd=yyyyyy",
    ],
)
def test_base_rules(text):
    assert base_spans(text) == plain(text)


def test_layers_are_unwrapped_and_mapped():
    secret = "token=abcdef99"
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    uni = "".join(f"\\u{ord(c):04x}" for c in secret)
    for inner in (b64(f"é {secret} é"), b64(gzip.compress(b"data " + secret.encode())), quote(secret), uni, b64(quote(b64("xx " + secret + " yy"))), b64(b64(b64(secret + " padded text")))):
        text = f"é before {inner} after"
        base, spans, layers, complete = scan(text)
        new = [s for s in spans if s not in base and s[1] == 0]
        assert layers >= 1 and complete and new, inner
        assert all(text.index(inner) <= s and e <= text.index(inner) + len(inner) for s, _, e in new)
    # A secret half written in escapes spans plain and escaped characters.
    text = "a tok%65n=abcdefgh b"
    assert [text[s:e] for s, _, e in scan(text)[1]] == ["tok%65n=abcdefgh"]
    # base64 maps to its own characters.
    text = "zz " + b64("123456789 " + KEY + " 123")
    (s, k, e), = scan(text)[1]
    assert k == 1 and base64.b64decode(text[3 + (s - 3) // 4 * 4 : 3 + -(-(e - 3) // 4) * 4]).count(b"AKIA") == 1


def test_cycles_and_bombs_end():
    assert scan("%25" * 1000)[3] and scan("%2525252541")[2] >= 2
    bomb = base64.b64encode(gzip.compress(b"a" * 3_000_000)).decode()
    assert scan(bomb, 1 << 20)[3] is False and scan(bomb)[3] is True
    deep = "token%3Dabcdefgh".replace("%", "%" + "25" * 1500)
    assert (0, 0) in {s[:2] for s in scan(deep)[1]} and scan("%" + "25" * 40_000)[3] is False


def test_large_payloads_are_scanned_to_their_end():
    b64 = lambda x: base64.b64encode(x).decode()
    limit = 1 << 18
    log = b"".join(b"line %d of the log, well\n" % i for i in range(120_000))  # 3 MB, many times the limit
    late = b64(gzip.compress(log + b"token=abcdefgh\n" + b64(gzip.compress(b"x " + KEY.encode())).encode() + b"\n" + log))
    for text in (late, b64(bz2.compress(log + b"token=abcdefgh " + KEY.encode())), b64(lzma.compress(log + b"token=abcdefgh " + KEY.encode()))):
        _, spans, layers, complete = scan("a " + text, limit)
        assert complete and {s for s in spans if s[1] < 2} >= {(2, 0, 2 + len(text)), (2, 1, 2 + len(text))} and layers <= 2
    # Secrets at every place of a piece's end.
    for pad in range(0, 40, 3):
        text = b64(gzip.compress(b"\n" + b"a b " * ((BLOCK - 40) // 4) + b" " * pad + b"\ntoken = abcdefgh\n" + b"c\n" * 50))
        assert scan(text)[1:] == ([(0, 0, len(text))], 1, True)


def test_a_bomb_takes_from_no_other_layer():
    b64 = lambda x: base64.b64encode(x).decode()
    bomb = b64(gzip.compress(b"z" * 3_000_000))
    small, url = b64(b"some text " + KEY.encode()), quote("passwd:hunter22", safe="").replace("u", "%75")
    text = f"{bomb} {small} {url} {b64(gzip.compress(b'x token=abcdefgh'))} end"
    _, spans, _, complete = scan(text, 1 << 20)
    assert not complete and sorted(k for _, k, _ in spans if k < 2) == [0, 0, 1]
    clean = redact(text, max_expanded=1 << 20)
    assert clean.startswith("[SECRET]") and clean.endswith(" end") and bomb not in clean and "hunter" not in clean and redact(text).startswith(bomb)


def test_base_spans_stay():
    text = f"secret: 'abcdef' {KEY} " + quote("password=hunter22")
    base, spans, *_ = scan(text)
    assert set(base) <= set(spans) and base == plain(text)


def test_documents(spark):
    rows = [(1, f"x {KEY}", "en", "a", 1), (1, f"x {KEY}", "en", "a", 1), (None, None, None, None, None), (3, "", "en", "a", 0), (4, "z" * 300_000 + " token=abcdef", "en", "a", 0)]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "'c' AS spans", "1 AS key")
    got = sorted(scan_documents(df).collect(), key=str)
    assert len(got) == 5
    none = hashlib.sha256(b"").hexdigest()
    assert [(x.n_access, x.spans) for x in got if x.doc_id == 1] == [(1, "access:2:22")] * 2
    assert all(x.base_sha256 == none and x.spans == "" for x in got if x.doc_id in (None, 3))
    assert [x.spans for x in got if x.doc_id == 4] == ["assign:300001:300013"]
    assert scan_documents(df.limit(0)).count() == 0


def test_redaction(spark):
    assert redact(f"a {KEY} b token=abcdefg") == "a [SECRET] b [SECRET]" and redact(None) is None and redact("clean") == "clean"
    df = spark.createDataFrame([(1, f"a {KEY}", "en", "a", 22), (2, None, "en", "a", 7)], ROWS)
    got = redact_documents(df).orderBy("doc_id").collect()
    assert redact_documents(df).schema.names == df.schema.names
    assert (got[0].text, got[0].n_chars, got[1].text, got[1].n_chars) == ("a [SECRET]", 10, None, 7)


def every_layer(chars):
    """Spans of a text and all below it, by following every decoded copy; chars: (character, start, end) of the document."""
    text = "".join(c for c, *_ in chars)
    found = {(chars[s][1], k, chars[e - 1][2]) for s, k, e in plain(text)}
    decoded = len(chars) and isinstance(chars, list) and chars is not every_layer.root
    below, at = [], 0
    for m in re.finditer(r"%([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})", text):
        below += [*chars[at : m.start()], (chr(int(m[1] or m[2] or m[3] or m[4], 16)), chars[m.start()][1], chars[m.end() - 1][2])]
        at = m.end()
    if at:
        found |= every_layer(below + chars[at:])
    alphabet = r"[A-Za-z0-9+/_-]"
    runs = [(m.start(), m.end()) for m in re.finditer(alphabet + r"{16,}={0,2}", text)]
    runs += [(m.start(), m.end()) for m in re.finditer(rf"{alphabet}{{16,}}(\r?\n[ \t]*{alphabet}{{16,}})*(\r?\n[ \t]*{alphabet}+)?={{0,2}}", text) if "\n" in m[0]]
    for a, b in runs:
        own = [x for x in chars[a:b] if x[0] not in "\r\n\t ="]
        for skip in range(4):
            rest = own[skip:]
            rest = rest[: len(rest) - (len(rest) % 4 == 1)]
            data = base64.b64decode("".join(c for c, *_ in rest).replace("-", "+").replace("_", "/") + "=" * (-len(rest) % 4))
            units = [(chr(c), rest[i // 3 * 4 + i % 3][1], chars[b - 1][2] if i == len(data) - 1 else rest[i // 3 * 4 + i % 3 + 1][2]) for i, c in enumerate(data)]
            if units:
                found |= every_layer(units)
            # What is all text, or compressed data, is no other text from another place.
            if (data and not re.search(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", data) and data.decode("utf-8", "ignore").encode() == data) or data[:3] == b"\x1f\x8b\x08":
                break
    if decoded:
        raw = "".join(c if ord(c) < 256 else "?" for c in text).encode("latin-1")
        upto = 0
        for m in re.finditer(rb"\x1f\x8b\x08|BZh[1-9]1AY|\xfd7zXZ\x00|x\x9c", raw):
            rest, out = raw[m.start() :], b""
            if m.start() < upto:
                continue
            try:
                while rest[:2] in (b"\x1f\x8b", b"BZ", b"\xfd7", b"x\x9c"):
                    unpacker = zlib.decompressobj(47) if rest[:1] in b"\x1fx" else bz2.BZ2Decompressor() if rest[:1] == b"B" else lzma.LZMADecompressor()
                    out += unpacker.decompress(rest)
                    rest = unpacker.unused_data
            except Exception:  # noqa: BLE001, S110
                pass
            if out:
                end = upto = len(raw) - len(rest)
                found |= every_layer([(chr(c), chars[m.start()][1], chars[end - 1][2]) for c in out])
    return found


def test_spans_equal_brute_force_on_random_nestings():
    r = random.Random(11)
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode("latin-1")).decode()
    wraps = [
        lambda x: b64(x), lambda x: base64.urlsafe_b64encode(x.encode("latin-1")).decode(), lambda x: b64(gzip.compress(x.encode("latin-1"), mtime=0)), lambda x: b64(zlib.compress(x.encode("latin-1"))),
        lambda x: b64(bz2.compress(gzip.compress(x.encode("latin-1"), mtime=0))), lambda x: b64(lzma.compress(x.encode("latin-1"))), lambda x: quote(x.encode("latin-1")), lambda x: "".join(f"%{ord(c):02x}" for c in x),
        lambda x: "".join(f"\\u{ord(c):04x}" for c in x), lambda x: "".join(f"\\x{ord(c):02x}" if r.random() < 0.5 else c for c in x), lambda x: base64.encodebytes(x.encode("latin-1")).decode(), lambda x: "path/to-" + b64(x),
        lambda x: "".join(f"%{b:02X}" for b in gzip.compress(x.encode("latin-1"), mtime=0)), lambda x: b64(b"\0\1\xff" + x.encode("latin-1")), lambda x: b64(gzip.compress(x[:9].encode("latin-1"), mtime=0) + gzip.compress(x[9:].encode("latin-1"), mtime=0)),
    ]
    deepest = 0
    for _ in range(150):
        text = ""
        for _ in range(r.randint(1, 3)):
            inner = r.choice(["token=abcdef99", f"an {KEY}", "f" * 30, "passwd: 'hunter22'", "nothing here at all"])
            depth = r.randint(0, 4)
            deepest = max(deepest, depth)
            for _ in range(depth):
                inner = r.choice(wraps)(r.choice(["", "some words ", "\xe9\n"]) + inner + r.choice(["", " and more", "\nline"]))
            text += r.choice(["", "漢 "]) + inner + r.choice([" ", "\n", ", "])
        every_layer.root = [(c, i, i + 1) for i, c in enumerate(text)]
        got = scan(text)
        assert got[1] == sorted(every_layer(every_layer.root)) and got[3], text
    assert deepest == 4


def test_spans_equal_brute_force_on_documents():
    import pyarrow.parquet as pq

    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist():
        every_layer.root = [(c, i, i + 1) for i, c in enumerate(text or "")]
        assert scan(text)[1] == sorted(every_layer(every_layer.root) if text else [])


@pytest.mark.parametrize("inner", ["gz gz", "bz gz", "members", "nul", "utf16", "glued", "dash"])
def test_layers_that_need_a_fixpoint(inner):
    s = b"xx token=abcdef99 yy and some more"
    b64 = lambda x: base64.b64encode(x).decode()
    text = {
        "gz gz": b64(gzip.compress(gzip.compress(s))), "bz gz": b64(bz2.compress(gzip.compress(s))), "members": b64(gzip.compress(s[:8]) + gzip.compress(s[8:])),
        "nul": b64(b"\0" + s), "utf16": b64(s.decode().encode("utf-16")), "glued": "blob/" + b64(s), "dash": "id-" + b64(s),
    }[inner]
    _, spans, _, complete = scan(text)
    assert complete and [k for _, k, _ in spans] == [0]


def test_mixed_levels_do_not_multiply():
    for levels in (12, 200):
        inner = "="
        for i in range(levels):
            inner = (f"%{ord(inner[0]):02x}" if i % 2 else f"\\u{ord(inner[0]):04x}") + inner[1:]
        text = f"token{inner}abcdefgh{inner}"
        began = time.perf_counter()
        assert scan(text)[1:] == ([(0, 0, len(text))], levels, True)
        assert time.perf_counter() - began < 2
