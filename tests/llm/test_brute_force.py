"""Quotation linking, language ID and packing against plain versions of their rules."""

import random
import re
import zlib
from collections import Counter

import pytest

from erario.llm import chat, langid, packing, queries


# ------------------------------------------------------------ quotation linking

def _lines(text):
    out = []
    for x in re.split("\r\n|\n|\r", text):
        marks = re.match(r"[ \t]*((?:>[ \t]?)*)", x)
        out.append((marks.group(1).count(">"), re.sub("[^a-z0-9]+", " ", x[marks.end():].lower()).strip()))
    return out


def _passages(text):
    """(level, run, part, line) of every line with a word."""
    lines, out, i = _lines(text), [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and lines[j][0] == lines[i][0]:
            j += 1
        keys = [k for _, k in lines[i:j]]
        parts, part = [], []
        for k in keys:
            part.append(k)
            if k == "":
                parts, part = [*parts, part], []
        for part in [*parts, part]:
            out += [(lines[i][0], " ".join(filter(None, keys)), " ".join(filter(None, part)), k) for k in part if k]
        i = j
    return out


def _threads(messages):
    """turn -> (reply_to, depth, n_quoted, max_level, position) of one conversation."""
    first, out, before = {}, {}, None
    for position, (turn, text) in enumerate(messages):
        links = {}
        for level, *names in _passages(text):
            known = [first[n] for n in names if n in first]
            if level and known:
                links.setdefault(level, Counter())[known[0]] += 1
        reply_to, n_quoted = before, 0
        if links:
            found = links[min(links)]
            reply_to, n_quoted = max(found, key=lambda s: (found[s], s)), sum(found.values())
        depth = 0 if reply_to is None else out[reply_to][1] + 1
        out[turn] = (reply_to, depth, n_quoted, max(level for level, _ in _lines(text)), position)
        for level, *names in _passages(text):
            if level == 0:
                for n in names:
                    first.setdefault(n, turn)
        before = turn
    return out


def _conversation(rnd, n):
    messages, turn = [], 0
    for _ in range(n):
        turn += rnd.choice([1, 1, 2, 300])
        lines = []
        for _ in range(rnd.randrange(1, 4)):
            if messages and rnd.random() < 0.6:
                quoted = re.split("\n", rnd.choice(messages)[1])
                a = rnd.randrange(len(quoted))
                quoted = quoted[a:a + rnd.randrange(1, 6)]
                if rnd.random() < 0.3 and not any(x.startswith(">") for x in quoted):
                    quoted = [" ".join(quoted)]  # wrapped at another place
                lines += [rnd.choice(["> ", ">", " > "]) + rnd.choice([x, x.upper()]) for x in quoted]
            else:
                lines += [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 4))) for _ in range(rnd.randrange(1, 4))]
        messages.append((turn, "\n".join(lines)))
    return messages


@pytest.mark.parametrize("seed", [1, 2])
def test_nested_quotes_against_plain_linking(spark, seed):
    rnd = random.Random(seed)
    talks = {c: _conversation(rnd, rnd.randrange(1, 30)) for c in range(25)}
    rows = [(c, t, "user", text) for c, messages in talks.items() for t, text in messages]
    rnd.shuffle(rows)
    found = chat.thread(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = {(r.conv_id, r.turn): (r.reply_to, r.depth, r.n_quoted, r.max_level, r.position) for r in found}
    want = {(c, t): x for c, messages in talks.items() for t, x in _threads(messages).items()}
    assert got == want
    assert sum(n > 0 for _, _, n, *_ in want.values()) > 50 and max(x[3] for x in want.values()) > 2


def test_quote_linking_sql_on_nested_quotes(spark, tmp_path):
    """The given conversations hold no quotes, so the SQL is held against these too."""
    import duckdb

    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "bot", None]), text) for c in range(25) for t, text in _conversation(rnd, rnd.randrange(1, 30))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.QUERIES["op7_quote_linking"](spark, str(tmp_path))
    columns = sorted(found.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES['op7_quote_linking']})").fetchall()
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(want, key=str)


# ------------------------------------------------------------------ language ID

def _ranked(texts, size):
    """N-grams by falling count, ties by length and then by code point."""
    n = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            padded = f" {w} "
            n.update(w)
            n.update(padded[i:i + k] for k in (2, 3) for i in range(len(padded) - k + 1))
    return sorted(n, key=lambda g: (-n[g], len(g), g))[:size]


@pytest.mark.parametrize("size", [25, 400])
def test_out_of_place_distance_against_plain_sums(spark, size):
    rnd = random.Random(size)
    words = {k: ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 7))) for _ in range(60)]
             for k, letters in (("xa", "abcdeé"), ("xb", "cdefgñ"), ("xc", "aegiж"))}
    rows = []
    for i in range(150):
        lang = rnd.choice(list(words))
        own = [rnd.choice(words[lang if rnd.random() < 0.6 else rnd.choice(list(words))]) for _ in range(rnd.randrange(0, 40))]
        rows.append((i, " ".join(w + rnd.choice(["", ".", "9", "_"]) for w in own), rnd.choice([lang, lang, None])))
    rows += [(500, None, "xa"), (501, "12 34", "xb"), (502, "ππ", "xc"), (503, "A", None)]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    profiles = {k: _ranked([t for i, t, lang in rows if lang == k and t and i not in held], size) for k in words}
    want = {}
    for i, t, _ in rows:
        own = _ranked([t or ""], size)
        if not own:
            want[i] = (i in held, "und", 0.0)
            continue
        away = {k: sum(abs(r - p.index(g)) if g in p else size for r, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        want[i] = (i in held, best, 1 - away[best] / (size * len(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in langid.predict_languages(df, size=size, sample_docs=10**6).collect()}
    assert {i: x[:2] for i, x in got.items()} == {i: x[:2] for i, x in want.items()}
    assert all(abs(got[i][2] - want[i][2]) < 1e-12 for i in want)


# ---------------------------------------------------------------------- packing

def _best_fit(sizes, length, most, min_cut):
    """(doc, start, size) by window in the order of emission, and what stays open."""
    opened, emitted = [], []

    def used(window):
        return sum(n for _, _, n in window)

    for doc, n in enumerate(sizes):
        start = 0
        while n >= length:
            emitted.append([(doc, start, length)])
            start, n = start + length, n - length
        if not n:
            continue
        fitting = [w for w in opened if used(w) + n <= length]
        if not fitting and len(opened) == most:
            fullest = max(opened, key=used)
            opened.remove(fullest)
            emitted.append(fullest)
            gap = length - used(fullest)
            if gap >= min_cut:
                fullest.append((doc, start, gap))
                start, n = start + gap, n - gap
        if not fitting:
            opened.append([])
            fitting = [opened[-1]]
        best = max(fitting, key=used)
        best.append((doc, start, n))
        if used(best) == length:
            opened.remove(best)
            emitted.append(best)
    return emitted, opened


@pytest.mark.parametrize("seed", range(20))
def test_windows_against_plain_best_fit(seed):
    rnd = random.Random(seed)
    length, most, min_cut = rnd.choice([8, 32, 100]), rnd.choice([1, 3, 8]), rnd.choice([1, 4, 1000])
    sizes = [rnd.choice([rnd.randrange(1, length), rnd.randrange(1, 3 * length), length, 1]) for _ in range(200)]
    packer = packing.Packer(length, most, min_cut, 7)
    for doc, n in enumerate(sizes):
        packer.add(doc, 0, bytes(4 * n), n)
        assert len(packer.open) <= most
    emitted, opened = _best_fit(sizes, length, most, min_cut)
    got = {}
    for doc, start, n, _, total, sequence, offset in packer.take():
        assert total == sizes[doc] and offset == sum(k for _, _, k in got.get(sequence, []))
        got.setdefault(sequence, []).append((doc, start, n))
    assert got == dict(enumerate(emitted, 7))
    assert [[(d, s, len(i) // 4) for d, s, i, _ in pieces] for _, pieces in packer.open] == opened
    held = sum(n for w in opened for _, _, n in w)
    packer.close()
    ends = {}
    for _, _, n, _, _, sequence, offset in packer.take():
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + n
    # nothing is lost, and what is not whole has a power of two, so it needs no padding
    assert sum(ends.values()) == held and all(n == length or n & (n - 1) == 0 for n in ends.values())
