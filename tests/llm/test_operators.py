"""The operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import common, components, exact_dedup, jaccard, line_dedup, mixing, pieces, quality, rangecoder, secrets, token_files, url_rules, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = P.path("word_bpe_49k.json")
PIECES = P.path("piece_bpe_32k.model")


def frame(spark, rows, ddl="doc_id long, text string", parts=5):
    return spark.createDataFrame(rows, ddl).repartition(parts)


def clashing(df):
    """Columns with names that the operators use themselves."""
    names = ("n", "kept", "keep_id", "row", "size", "digest", "key", "w", "k", "h", "set_id", "bucket", "blob", "found", "copies", "target", "host", "rule", "sha", "payload", "norm", "body", "__id", "__sha", "__name")
    return df.withColumns({c: F.lit("x") for c in names if c not in df.columns})


TEXTS = [
    (0, None), (1, ""), (2, " \n\t"), (3, "a b c"), (4, "a  b\tc"), (5, "A b c"), (6, "x" * 30_000), (7, "same text here and there"), (7, "same text here and there"), (8, "same text here and there"),
    (None, "same text here and there"), (None, None), (9, "l1 w\nl2 w\nl3 w\nl4 w"), (10, "é\r\n日本語 ﬁ\x00 <s>"), (11, "same  text here and there"),
]


# --- 1 ---

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("example.org", "/es/a/b", "allow"), ("a.com", "", "block"), ("com", "/de/", "allow"), (None, "/", "block")]


def brute_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(url_rules.UPPER, url_rules.LOWER)), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules(spark):
    rnd = random.Random(1)
    hosts = ["org", "example.org", "WWW.Example.org", "notexample.org", "a.com", "b.a.com", "com", "x.com:80", "", "net", "a..com", ".".join("abcdefgh") + ".com"]
    paths = ["", "/", "/es", "/es/", "/es/a/b/c", "/es/é\U0010ffff", "/en/1", "/en/12", "/fr/x", "/de/", "/de/q?x=/fr/", "/a#/de/"]
    urls = [None, "", "example.org/es/", "a://b://c/de/", "http://"] + [f"{s}{h}{p}" for s in ("http://", "HTTPS://") for h in hosts for p in paths]
    rows = [(k if k % 17 else None, u) for k, u in enumerate(urls)] + [(5, "http://com/de/")] * 3
    rows += [(rnd.randint(0, 9), "http://example.org/es/a/b") for _ in range(3000)]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = Counter(map(tuple, url_rules.url_rules(clashing(frame(spark, rows, "page_id long, url string")), rules).collect()))
    assert got == Counter((i, *brute_rule(u)) for i, u in rows)
    assert url_rules.url_rules(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    none = url_rules.url_rules(frame(spark, [(1, "http://a.com/")], "page_id long, url string"), rules.limit(0), default="block").first()
    assert (none.rule, none.verdict) == (None, "block")


# --- 2 ---


def brute_dedup(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    group = defaultdict(list)
    for (i, _), t in zip(rows, norm):
        group[t].append((i is None, i))
    return norm, {t: (min(g)[1], len(g)) for t, g in group.items()}


@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_dedup(spark, fan_in):
    rnd = random.Random(2)
    rows = TEXTS + [(100 + k, f"t{rnd.randint(0, 40)}  {'x' * rnd.randint(0, 2)}") for k in range(600)] + [(k, "hot") for k in range(700, 1200)]
    norm, group = brute_dedup(rows)
    got = exact_dedup.exact_dedup(clashing(frame(spark, rows)), fan_in=fan_in).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((i, *group[t], hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm))
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert len(kept) == len(group) and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact_dedup.kept_documents(clashing(frame(spark, rows)))
    assert len(left.columns) > 10
    assert Counter((r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in left.collect()) == Counter((g[0], t) for t, g in group.items())
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- 3 ---


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, rangecoder.BLOCK, rangecoder.BLOCK + 1, 2 * rangecoder.BLOCK + 77])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), rng.zipf(1.3, n) % 49408, np.full(n, 49407), np.arange(n) % 37):
        blocks = rangecoder.encode(ids.astype(np.uint16), 49408)
        assert (rangecoder.decode(blocks, 49408) == ids).all() and sum(b[0] for b in blocks) == n
    if n:
        size, crc, code = blocks[0]
        with pytest.raises(ValueError):
            rangecoder.decode([(size, crc ^ 1, code)], 49408)
        one = rangecoder.decode(blocks[-1:], 49408)  # a block stands alone
        assert (one == ids[len(ids) - blocks[-1][0] :]).all()


def test_range_coder_predicts():
    ids = np.tile(np.arange(500, 560, dtype=np.uint16), 200)
    assert sum(len(b[2]) for b in rangecoder.encode(ids, 49408)) < len(ids) * 2 / 10


def test_token_files(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(5)
    parts = ["<|endoftext|>", " ", "\n", "'s", "don't", "ΑΣ ", "é", "é", "　", "\x85", "\x1c", "日本", "1234", "--", "a", "B", "ing", "ẛ̣", "🙂", "İ"]
    rows = [(k, "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40)))) for k in range(20, 400)] + [r for r in TEXTS if r[0] != 7] + [(7, "same")] * 2
    lib = Tokenizer.from_file(WORDS)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    ids = [x.ids + [2] for x in lib.encode_batch([t or "" for _, t in order], add_special_tokens=False)]
    manifest = token_files.write_tokens(clashing(frame(spark, rows)), token_files.token_folder(spark), WORDS)
    got = sorted(token_files.read_tokens(manifest).collect(), key=lambda r: r.start)
    start = 0
    assert [r.doc_id for r in got] == [i for i, _ in order]
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(x)) for (i, _), x in zip(order, ids))
    assert token_files.read_tokens(token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), token_files.token_folder(spark), WORDS)).count() == 0


# --- 4 ---


def test_pieces_equal_the_library(spark):
    rnd = random.Random(4)
    alpha = "abcdehtnis  \n▁éß日😀　\t."
    rows = TEXTS + [(100 + k, "".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 60)))) for k in range(800)] + [(2000, "ab" * 700 + " " * 300 + "▁x"), (2001, " " * 400), (2002, "a" * 5000)]
    enc = pieces.Pieces(PIECES).lib
    got = pieces.encode_decode(clashing(frame(spark, rows)), PIECES).collect()
    want = Counter()
    for i, t in rows:
        ids = [1, *enc.encode(t or ""), 2]
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(enc.decode(ids).encode()).hexdigest(), enc.decode(ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded) for r in got) == want
    assert pieces.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0


def test_pieces_of_long_words_equal_the_library():
    rnd = random.Random(11)
    p = pieces.Pieces(PIECES)
    texts = ["ab" * 7000, "a" * 50_000, base64.b64encode(rnd.randbytes(30_000)).decode(), "abcabcab" * 2000, "x" * 100_001, "日本" * 5000, "ababc" * 3, *("".join(rnd.choice(a) for _ in range(rnd.randint(1, n))) for a in ("ab", "aeinrst", "etaoinshrdlu ") for n in (12, 300, 5000) for _ in range(60))]
    ids, n = pieces.Encoder(p).encode(texts)
    at = 0
    for t, k in zip(texts, n.tolist()):
        assert ids[at : at + k].tolist() == [1, *p.lib.encode(t), 2]
        at += k


def test_decoding_of_any_ids_equals_the_library():
    p = pieces.Pieces(PIECES)
    rnd, encoder = random.Random(6), pieces.Encoder(p)
    runs = [[rnd.randrange(1, p.size) if rnd.random() < 0.6 else rnd.randrange(1, 300) for _ in range(rnd.randint(1, 12))] for _ in range(500)]
    flat = np.array([i for r in runs for i in r])
    got = encoder.decode(flat, np.array([len(r) for r in runs]))
    assert got == [p.lib.decode(r) for r in runs]


# --- 5 ---


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "long text " * 200_000
    rows = [(k, f"http://h/{k}", f"<html>{k % 40}</html>") for k in range(300)] + [(900, None, None), (901, "http://e\r\n/x", ""), (902, "u", big), (903, "v", big), (None, "w", "only"), (None, "w", "<html>1</html>"), (5, "again", "<html>5</html>")]
    manifest = warc.write_warc(clashing(frame(spark, rows, "page_id long, url string, html string", 3)), warc.archive_folder(spark))
    got = warc.read_warc(manifest).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        to = first.get(h or "")
        revisit = to is not None and to != i
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", to if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    kept = {r.payload_digest: r.payload for r in got if r.record_type == "response"}
    assert all(base64.b32encode(hashlib.sha1(p).digest()).decode() == d for d, p in kept.items())
    least = warc.read_warc(warc.write_warc(frame(spark, rows[:300], "page_id long, url string, html string"), warc.archive_folder(spark), least=1000))
    assert least.where("record_type = 'revisit'").count() == 0
    empty = warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), warc.archive_folder(spark))
    assert warc.read_warc(empty).count() == 0


def test_archives_hold_valid_records(spark):
    rows = [(k, f"http://h/{k}", f"<html>{k % 7}</html>") for k in range(60)] + [(100, None, None)]
    write = lambda: warc.write_warc(frame(spark, rows, "page_id long, url string, html string", 3), warc.archive_folder(spark))
    seen = []
    for _ in range(2):
        ids, refers, kinds = {}, [], Counter()
        for r in write().collect():
            with common.open_at(r.path, "rb") as f:
                raw = list(warc.read_records(f))
            assert len(raw) == r.records
            for k, x in enumerate(raw):
                head, block = warc.parsed(x)
                kinds[head["WARC-Type"]] += 1
                assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type"} <= set(head) and x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n")
                assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", head["WARC-Record-ID"]) and (k == 0) == (head["WARC-Type"] == "warcinfo")
                if k:
                    status, _, rest = block.partition(b"\r\n")
                    assert head["Content-Type"] == "application/http; msgtype=response" and status == b"HTTP/1.1 200 OK"
                    n, body = warc.body_of(block)
                    assert head["WARC-Record-ID"] not in ids
                    ids[head["WARC-Record-ID"]] = head["WARC-Type"]
                    if head["WARC-Type"] == "response":
                        assert n == len(body) and warc.digest(body) == head["WARC-Payload-Digest"].removeprefix("sha1:")
                    else:
                        assert head["WARC-Profile"] == warc.PROFILE and body == b""
                        refers.append(head["WARC-Refers-To"])
        assert len(refers) == 53 and all(ids[x] == "response" for x in refers)
        assert kinds["response"] == 8 and kinds["revisit"] == 53
        seen.append(sorted(ids))
    assert seen[0] == seen[1]  # ids do not depend on the attempt


def test_archives_begin_with_their_dictionary(tmp_path):
    at = str(tmp_path / "x.warc.zst")
    out = warc.Writer(warc.open_at(at, "wb"))
    raw = [warc.record({"WARC-Type": "response", "k": k}, f"<html><body>page {k} {k * 7919} of the site</body></html>".encode() * 3) for k in range(400)]
    for r in raw:
        out.add(r)
    out.close()
    with open(at, "rb") as f:
        assert int.from_bytes(f.read(4), "little") == warc.DICTIONARY_FRAME
        f.seek(0)
        assert list(warc.read_records(f)) == raw
    with open(at, "rb") as f, pytest.raises(ValueError):
        (tmp_path / "cut").write_bytes(f.read()[:-3])
        with open(tmp_path / "cut", "rb") as g:
            list(warc.read_records(g))


# --- 6 ---


def brute_quality(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n, cover = Counter(runs), set()
    for k, x in enumerate(runs):
        if n[x] > 1:
            cover.update(range(k, k + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def thue_morse(n, a, b):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_structured_lines_and_words_are_told_apart(spark):
    """Strings on which a hash that is linear modulo 2**64 collides: Thue-Morse strings and their complements."""
    rows = []
    for k, n in enumerate((1024, 2048, 4096)):
        x, y = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
        rows += [(10 * k, f"{x}\n{y}\n{x}"), (10 * k + 1, f"{x}\n{y}"), (10 * k + 2, " ".join(thue_morse(n, "ab", "cd")[2 * j : 2 * j + 2] for j in range(n))), (10 * k + 3, x), (10 * k + 4, y)]
        rows += [(10 * k + 5, f"one two {x} four five"), (10 * k + 6, f"one two {y} four five")]
    got = {tuple(r)[:-1] for r in quality.quality(frame(spark, rows)).collect()}
    assert got == {(i, *brute_quality(t)) for i, t in rows}
    assert Counter(map(tuple, jaccard.ngram_jaccard(frame(spark, rows)).collect())) == brute_near(rows)


def test_very_long_texts(spark):
    """Beyond a stretch of one megabyte, with one word of two megabytes and with blanks only."""
    rnd = random.Random(12)
    words = [f"w{rnd.randrange(5000)}" for _ in range(600_000)]
    other = [*words[:590_000], *(f"v{k}" for k in range(10_000))]
    rows = [(1, " ".join(words)), (2, "\t".join(other)), (3, "x" * 2_000_000), (4, "x" * 2_000_000 + "y"), (5, " \n" * 1_000_000), (6, "é" * 700_000 + " a b c"), (7, "short")]
    got = {tuple(r)[:-1] for r in quality.quality(frame(spark, rows)).collect()}
    assert got == {(i, *brute_quality(t)) for i, t in rows}
    assert Counter(map(tuple, jaccard.ngram_jaccard(frame(spark, rows)).collect())) == brute_near(rows)


def test_quality(spark):
    rnd = random.Random(7)
    rows = TEXTS + [(100 + k, "".join(rnd.choice("ab \n#é\r") for _ in range(rnd.randint(1, 200)))) for k in range(500)]
    vocab = [f"{a}{b}{c}" for a in "prstl" for b in "aeio" for c in ("n", "r", "st", "m")]
    prose = " ".join(rnd.choice(vocab) for _ in range(3000))
    noise = base64.b85encode(random.Random(1).randbytes(9000)).decode()
    noise = " ".join(noise[k : k + 9] for k in range(0, len(noise), 9))
    rows += [(5000, prose), (5001, noise), (5002, "".join(f"ab{k} " for k in range(3000)))]
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed): r.kept for r in quality.quality(clashing(frame(spark, rows))).collect()}
    assert set(got) == {(i, *brute_quality(t)) for i, t in rows}
    by_id = {k[0]: v for k, v in got.items()}
    assert by_id[5000] and not by_id[5001]
    assert not any(v for k, v in got.items() if k[-1])
    left = quality.clean_documents(clashing(frame(spark, rows))).collect()
    assert Counter(r.doc_id for r in left) == Counter(k[0] for k, v in got.items() if v)
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repetitive_text_leaves_the_band():
    import zstandard

    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    assert not quality.in_band(packer, memoryview(b"buy now and save " * 400))
    assert quality.in_band(packer, memoryview(b""))


def test_word_stuffed_texts_leave_the_band(spark):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("aeioulnrstdm") for _ in range(rnd.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(vocab[int(len(vocab) * rnd.random() ** 2)] for _ in range(n))
    # one word over and over with another now and then, so that few runs of eight words occur twice
    stuffed = lambda n: " ".join(x for _ in range(n // 5) for x in [*["Ment"] * rnd.randint(1, 6), rnd.choice(vocab)])
    rows = [(k, prose(n)) for k, n in enumerate((25, 60, 120, 300, 900, 3000, 9000))] + [(100 + k, stuffed(n)) for k, n in enumerate((25, 50, 100, 200))]
    got = {r.doc_id: r for r in quality.quality(frame(spark, rows)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if r.kept} == {i for i, _ in rows if i < 100}


def test_a_bad_tail_leaves_the_band():
    import zstandard

    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    keeps = lambda text: quality.in_band(packer, memoryview(text))
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("aeioulnrstdm") for _ in range(rnd.randint(2, 9))) for _ in range(4000)]
    prose = " ".join(vocab[int(len(vocab) * rnd.random() ** 2)] for _ in range(5000)).encode()
    noise = base64.b85encode(rnd.randbytes(4000))
    for n in (4000, 4096, 4097, 5000, 8191, 8192, 12000, 20000):
        assert keeps(prose[:n])
    for n in (4096, 4500, 8192):
        assert not keeps(prose[:n] + noise[:4000])
    # one bad full chunk of three, then a sound tail
    assert not keeps(prose[:8192] + noise[:4096] + prose[:2000])
    assert keeps(prose[:20480] + noise[:2000])


# --- 7 ---

KINDS = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]


def brute_secrets(t):
    return sorted((m.start(), k, kind, m.end()) for k, (kind, p, g, least) in enumerate(KINDS) for m in re.finditer(p, t or "", re.ASCII) if len(m[g]) >= least)


def test_secrets(spark):
    rnd = random.Random(8)
    bits = ["password", "Token", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "abcdefgh", "1234", "AKIA", "ABCD1234", "deadbeef", "é", "\n", "😀", "secret", "/x.y", "ſecret"]
    rows = TEXTS + [(100 + k, "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40)))) for k in range(1500)] + [(k, "token: abcdefgh1") for k in range(5000, 5050)]
    found, added = secrets.scan(clashing(frame(spark, rows)))
    got = Counter((r["path"], tuple((s.start, s["rank"], s.kind, s.end) for s in r.found if s.kind in secrets.BASE)) for r in found.collect())
    assert got == Counter((i, tuple(brute_secrets(t))) for i, t in rows)
    e = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.scan(e)[0].count() == 0


def test_ledger_scans_only_what_is_new(spark):
    first = frame(spark, [(1, "token=abcdefgh"), (2, "x")])
    found, ledger = secrets.scan(first)
    ledger = common.written(ledger, "ledger")
    assert ledger.count() == 2
    later = frame(spark, [(3, "token=abcdefgh"), (2, "x"), (4, "AKIAABCDEFGH1234")])
    found, added = secrets.scan(later, ledger)
    assert added.count() == 1  # one new blob
    assert {r["path"]: len(r.found) for r in found.collect()} == {3: 1, 2: 0, 4: 1}
    # a new version of one rule is scanned anew, the others come from the ledger
    rules = [("assign", 2, r"(?i:token)=([a-z]+)", 1, 3, "(?i:token)")] + list(secrets.RULES[1:])
    both = common.written(ledger.unionByName(added), "ledger")
    found, added = secrets.scan(later, both, rules)
    assert [[s.kind for s in r.scanned] for r in added.collect()] == [["assign"]] * 3
    assert {r["path"]: [s.kind for s in r.found] for r in found.collect()} == {3: ["assign"], 2: [], 4: ["access"]}


def test_ledger_in_the_shared_folder(spark):
    at = secrets.open_ledger(spark)
    first = frame(spark, [(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, None)])
    want = {1: ["assign"], 2: ["assign"], 3: []}
    assert {r["path"]: [s.kind for s in r.found] for r in secrets.scan_into(first, at).collect()} == want
    assert secrets.read_ledger(spark, at).count() == 2
    later = frame(spark, [(1, "token=abcdefgh"), (4, "AKIAABCDEFGH1234"), (5, "")])
    assert {r["path"]: [s.kind for s in r.found] for r in secrets.scan_into(later, at).collect()} == {1: ["assign"], 4: ["access"], 5: []}
    assert secrets.read_ledger(spark, at).count() == 3


# --- 8 ---


def water(sizes, weights, share, cap):
    total, out, free = share * sum(sizes), {}, set(range(len(sizes)))
    while free:
        level = (total - sum(out.values())) / sum(weights[k] for k in free)
        over = [k for k in free if level * weights[k] > cap * sizes[k]]
        if not over:
            return {**out, **{k: level * weights[k] for k in free}}
        for k in over:
            out[k] = cap * sizes[k]
            free.remove(k)
    return out


def test_mix(spark):
    rnd = random.Random(9)
    rows = [(k, " ".join(["w"] * rnd.randint(0, 60)), rnd.choice(["a", "b", "c", None, "é", "Z"] + ["hot"] * 6)) for k in range(4000)] + [(None, None, "a"), (5, "x y", "a"), (5, "x y", "a"), (8000, "w " * 20000, "c"), (8001, "", "empty")]
    df = clashing(frame(spark, rows, "doc_id long, text string, source string"))
    sizes = mixing.sizes_of(df, F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(0.5))
    got = mixing.mix(sizes, bucket_rows=100).collect()
    per = defaultdict(int)
    for _, t, s in rows:
        per[s] += len(WORD.findall(t or ""))
    names = sorted(per, key=lambda s: (s is None, s or ""))
    want = water([per[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5, 2)
    want = {s: want[k] for k, s in enumerate(names)}
    assert len(got) == len(rows)
    by_size = {per[s]: want[s] for s in names}
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(by_size[r.source_size]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source_size] += r.taken
    for s in names:
        assert abs(taken[per[s]] - want[s]) <= 20000 / 2 + 1 if s == "c" else abs(taken[per[s]] - want[s]) <= 31
    again = mixing.mix(mixing.sizes_of(df.repartition(3), F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(0.5)), bucket_rows=17).collect()
    key = lambda rs: Counter((r.doc_id, r["size"], r.taken) for r in rs)
    assert key(again) == key(got)
    assert mixing.mix(mixing.sizes_of(spark.createDataFrame([], "doc_id long, text string, source string"))).count() == 0
    # a heavier weight is drawn more often where a part of the source is taken
    hot = [r for r in got if r.source_size == per["hot"] and r["size"]]
    share = lambda odd: np.mean([r.taken > 0 for r in hot if r.doc_id % 2 == odd])
    if want["hot"] < per["hot"]:
        assert share(0) > share(1)


def test_mixed_documents_keep_columns(spark):
    rows = [(k, f"word {k} " * (k % 9), "ab"[k % 2]) for k in range(200)]
    df = clashing(frame(spark, rows, "doc_id long, text string, source string"))
    out = mixing.mixed_documents(df, spark.createDataFrame([(1, 5.0)], "i long, q double"))
    assert out.columns == df.columns
    n = Counter(r.doc_id for r in out.collect())
    assert max(n.values()) <= 2 and abs(sum(n[k] * (k % 9) * 2 for k in n) - 1.5 * sum((k % 9) * 2 for k in range(200))) <= 20


# --- 9 ---


def brute_lines(rows):
    docs = list(dict.fromkeys(rows))
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
    seen, gone = set(), defaultdict(set)
    for k in order:
        lines = (docs[k][1] or "").split("\n")
        for p in range(len(lines) - 2):
            win = tuple(lines[p : p + 3])
            if any(WORD.search(x) for x in win):
                if win in seen:
                    gone[docs[k]].update((p, p + 1, p + 2))
                seen.add(win)
    return {d: [x for n, x in enumerate((d[1] or "").split("\n")) if n not in gone[d]] for d in docs}


def test_line_dedup(spark):
    rnd = random.Random(10)
    rows = [(k, "\n".join(rnd.choice(["a", "b", "c", "", " ", f"u{k}", "é"]) for _ in range(rnd.randint(1, 25)))) for k in range(300)]
    rows += [r for r in TEXTS if r[0] is not None] + [(None, "x\ny\nz")] + [(k, "p\nq\nr\ns") for k in range(1000, 1400)] + [(2000, "n\n" * 20_000)]
    want = brute_lines(rows)
    got = line_dedup.line_dedup(clashing(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    texts = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got)
    full = Counter((i, "\n".join(want[(i, t)]), len((t or "").split("\n")), len((t or "").split("\n")) - len(want[(i, t)])) for i, t in rows)
    assert texts == full
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_with_edges_finds_short_texts(spark):
    rows = [
        (1, "one line of its own"), (2, "one line of its own"), (3, "two lines\nof a text"), (4, "two lines\nof a text"), (5, "head a\nhead b\nu5\nv5\ntail a\ntail b"), (6, "head a\nhead b\nu6\nv6\ntail a\ntail b"),
        (7, "u7\nhead a\nhead b\nv7"), (8, "one line of its own\nu8"), (9, ""), (10, ""), (11, " "), (12, " "), (13, None), (14, "a\nb\nc\nd"), (15, "x\nb\nc\nd"),
    ]
    got = {r.doc_id: (r.text, r.n_lines, r.removed) for r in line_dedup.line_dedup(clashing(frame(spark, rows)), edges=True).collect()}
    gone = {2: ("", 1, [1]), 4: ("", 2, [1, 2]), 6: ("u6\nv6", 6, [1, 2, 5, 6]), 15: ("x", 4, [2, 3, 4])}
    assert got == {i: gone.get(i, (t or "", len((t or "").split("\n")), [])) for i, t in rows}
    plain = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert {i for i, n in plain.items() if n} == {15}


# --- 10 ---


def brute_near(rows, size=5, percent=75):
    low = str.maketrans(url_rules.UPPER, url_rules.LOWER)
    sets, index = [], defaultdict(list)
    for k, (_, t) in enumerate(rows):
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
        for x in sets[-1]:
            index[x].append(k)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in index[x] if j < k)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                up[find(k)] = find(j)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return Counter((i, len(sets[k]), min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows))


def near_rows(seed):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    shared = [rnd.choice(vocab) for _ in range(60)]

    def edited(words, rate):
        words = list(words)
        for _ in range(int(len(words) * rate) + rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        return words

    rows = list(TEXTS)
    for _ in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([8, 30, 100, 300]))]
        for _ in range(rnd.choice([1, 5, 50])):
            now = edited(base, rnd.choice([0, 0.005, 0.02, 0.04, 0.06]))
            for _ in range(rnd.randint(1, 3)):
                rows.append((100 + len(rows), " ".join(now + (shared if rnd.random() < 0.2 else []))))
                now = edited(now, 0.03)
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_jaccard(spark, seed):
    rows = near_rows(seed)
    got = Counter(map(tuple, jaccard.ngram_jaccard(clashing(frame(spark, rows))).collect()))
    assert got == brute_near(rows)


def test_ngram_jaccard_empty_and_representatives(spark):
    assert jaccard.ngram_jaccard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(k, " ".join(f"a{j}" for j in range(40)) + f" z{k}") for k in range(50)] + [(99, "other words of a text that stands alone here"), (100, None)]
    left = jaccard.representatives(clashing(frame(spark, rows)))
    assert sorted(r.doc_id for r in left.collect()) == [0, 99, 100] and "blob" in left.columns


def test_few_edges_take_one_step_and_many_the_stars(spark, monkeypatch):
    rnd = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 300)] + [(rnd.randint(1000, 3000), rnd.randint(1000, 3000)) for _ in range(900)] + [(7000, -k) for k in range(1, 200)] + [(9000, 9000), (5, 5), (-4, 7000)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in edges:
        if a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    table = frame(spark, edges, "u long, v long", 40)
    spark.sparkContext.setJobGroup("few", "few edges")
    try:
        got = components.components(table)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert Counter(map(tuple, got.collect())) == Counter((x, top(x)) for x in root)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) <= 6
    assert components.components(table.where("u = v")).count() == 0
    monkeypatch.setattr(components, "FEW", 0)
    assert Counter(map(tuple, components.components(table).collect())) == Counter((x, top(x)) for x in root)


def test_new_words_go_to_the_library_together():
    class Spy:
        def __init__(self, lib):
            self.lib, self.texts = lib, []

        def encode_batch_fast(self, texts, add_special_tokens):
            self.texts += texts
            return self.lib.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    rnd = random.Random(8)
    cache = token_files.WordCache(WORDS)
    lib, cache.lib = cache.lib, Spy(cache.lib)
    plain = ["".join(rnd.choice("abcAB19.,'é日ﬁ\u0301\u0307İ") for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    plain += ["<|endoftext|>", "x<|startoftext|>y", "<|ENDOFTEXT|>", "\u0301", "\x02", "\x00", "\xa0", "\u2028", "\x85a", "\ufeff", "\x1c", "\u0958", "\ufb1d", "\u0344", "ªº", "ⅷ", "ʼn", "漢字"]
    marked = ["\x01", "a\x01b", "\x01\x01", "\x01c"]
    for words in (plain, marked + plain[:40], [w + "2" for w in plain[:900]] + marked):
        texts = [" ".join(words[k : k + 7]) for k in range(0, len(words), 7)]
        raw = [t.encode() for t in texts]
        cache.forget()
        cache.lib.texts.clear()
        ids, n = cache.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 2)
        want = [lib.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
        if words is plain:
            assert len(cache.lib.texts) < len(set(words)) / 3


def test_decoder_finds_ids_of_shares_with_few_steps():
    rng = np.random.default_rng(3)
    lanes, vocab, t = 6, 5000, 2048
    order0 = rangecoder.Order0(lanes, vocab)
    ids = (rng.integers(0, vocab, (lanes, t)) * rng.integers(0, 2, (lanes, t)) // 7 * 7).astype(np.uint16)
    order0.learn(ids, t)
    order0.share[:3] = (1, 2, 40)
    order0.total = order0.share * t + vocab
    inverse = rangecoder.Inverse(order0)
    inverse.learn()
    for lane in range(lanes):
        at = order0.share[lane] * order0.before[lane, :-1].astype(np.int64) + np.arange(vocab)
        w = np.arange(int(order0.total[lane]))
        of = np.full(len(w), lane)
        got = inverse(of, of * (vocab + 1), np.full(len(w), order0.share[lane]), w)
        assert (got == np.searchsorted(at, w, "right") - 1).all()

    class Counted(np.ndarray):
        taken = 0

        def take(self, *a, **b):
            Counted.taken += 1
            return np.asarray(self).take(*a, **b)

    fresh = rangecoder.Order0(1, vocab)  # nothing has occurred: no id needs bisection
    inverse = rangecoder.Inverse(fresh)
    inverse.learn()
    inverse.before = inverse.before.view(Counted)
    none = np.zeros(vocab, np.int64)
    assert (inverse(none, none, none, np.arange(vocab)) == np.arange(vocab)).all() and Counted.taken <= 2
