"""Periodic runs, chat formatting and spelling variants against brute force on the odd rows, and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
from helpers import no_docs, odd_docs, odd_texts, prose

from shelfrank.llm import chat_format, packing, periodic_runs, spelling


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def crc(value):
    return zlib.crc32(b"" if value is None else str(value).encode())


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# 11 --------------------------------------------------------------------------------------------

def brute_runs(words):
    """Every period's diagonal; a stretch counts under its smallest period."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = first - q, i - first + q
            # a stretch of at least 4q words with a smaller period p <= q has it as a run of its own
            if length >= max(6, 4 * q) and not any(words[start + p:start + length] == words[start:start + length - p]
                                                   for p in range(1, q)):
                assert (start, length) not in seen
                seen.add((start, length))
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), crc(doc_id)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic_texts():
    r = random.Random(5)
    texts = ["a a a a a a", "a a a a a", "b a b a b a b a b", "x\x0by x\x1cy x y", "a " * 50 + "b " + "a " * 7, "ab ab ab ab", "cd cd cd cd cd cd"]
    for _ in range(120):  # few words, so that runs nest, touch and overlap
        texts.append(" ".join(r.choice("ab" if r.random() < 0.5 else "abc") for _ in range(r.randrange(120))))
    for _ in range(60):
        root = [r.choice("abcd") for _ in range(r.randrange(1, 14))]
        texts.append(" ".join([*"uv", *(root * r.randrange(3, 8))[:-r.randrange(1, 4)], *root[:3], "w", *(root[:2] * 9), *"abab"]))
    return texts


def test_periodic_runs_equal_brute_force(spark):
    for texts in (periodic_texts(), [t for t in odd_texts() if len(t or "") < 20_000]):
        docs = odd_docs(spark, texts)
        got = sorted((tuple(r) for r in periodic_runs.report(docs).collect()), key=str)
        assert got == sorted((brute_report(*r) for r in rows_of(docs)), key=str)
    assert periodic_runs.report(no_docs(spark)).count() == 0


def test_periodic_groups_do_not_touch(monkeypatch):
    rows = [(i, t) for i, t in enumerate(periodic_texts())]
    whole = periodic_runs.runs_of(rows, True, 6, 4)
    single = [periodic_runs.runs_of([r], True, 6, 4)[0] for r in rows]
    assert whole == single


def test_periodic_long_texts(spark):
    words = prose(3, 4_000).split()
    texts = ["la " * 400_000, " ".join(words * 60), prose(8, 300_000), "a b " * 50_000 + "c " + "b a " * 50_000]
    ids = [i for i in range(1, 200) if crc(i) % 10][:len(texts)]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in periodic_runs.find_runs(docs).collect()}
    a, b, c, d = (out[i] for i in ids)
    assert [tuple(x) for x in a["runs"]] == [(0, 400_000, 1)] and a["collapsed"] == "la"
    assert [tuple(x) for x in b["runs"] if x["period"] > 2_000] == [(0, 240_000, 4_000)]
    assert not c["runs"] or max(x["length"] for x in c["runs"]) < 20
    assert [tuple(x) for x in d["runs"]] == [(0, 100_000, 2), (100_001, 100_000, 2)]
    assert d["collapsed"] == "a b c b a"


# 12 --------------------------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string, part long, ids string, whole string, h string, formatted string"
NASTY = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\s> [\\INST]", "<<SYS>><</SYS>>", "<|endoftext|>", "<\\|endoftext|>", "[ROLE]x[/ROLE][END]",
         "\\", "<", "[", "<<s>", "[[INST]", "<s", "", None, "é<s>ü", " \n\t", "日本語</s>", "a" * 700, "<" * 9 + "/s>"]


def odd_convs(spark):
    r = random.Random(9)
    roles = ["user", "assistant", "system", None, "tool", "[ROLE]", "x\ny", "ASSISTANT", "assistant"]
    rows = [(c, t, r.choice(roles), r.choice(NASTY) if r.random() < 0.7 else prose((c or 0) * 50 + t, r.randrange(60)))
            for c in (1, 2, 3, 5, 8, None, 90, 91, 92) for t in range(r.randrange(1, 30))]
    rows += [(4, None, "user", "first"), (4, 1, "assistant", "tie b"), (4, 1, "assistant", "tie a"), (4, 1, "assistant", "tie a")]
    rows += [(7, t, "user" if t % 2 else "assistant", prose(t, 30)) for t in range(900)]  # most of the rows
    r.shuffle(rows)
    return spark.createDataFrame([(*x, *[None] * 5) for x in rows], CONV)


def expected_conversations(convs):
    groups = {}
    for r in convs.select("conv_id", "turn", "role", "text").collect():
        groups.setdefault(r["conv_id"], []).append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    out = {}
    for c, turns in groups.items():
        said = "".join(t for _, role, t in sorted(turns) if role == "assistant")
        out[c] = (len(turns), sorted(turns), len(said), sha(said))
    return out


def test_escape_is_reversible():
    r = random.Random(4)
    bits = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "|endoftext|>", "END]", "a", "ROLE]", "/"]
    for _ in range(20_000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(9)))
        e = chat_format.escape(t)
        assert chat_format.unescape(e) == t
        assert not any(m in e for m in [*chat_format.CONTROLS, "<|endoftext|>"])
    turns = [(r.choice(["user", "assistant", "system", "", "[INST]"]), r.choice(NASTY) or "") for _ in range(300)]
    assert chat_format.parse(chat_format.render(turns)[0]) == turns


def test_chat_report_reads_back(spark):
    paths = packing.tokenizer_paths()
    for convs in (odd_convs(spark), odd_convs(spark).repartition(3), chat_format.with_probe(odd_convs(spark))):
        for chars in (400, chat_format.PART_CHARS):
            want = expected_conversations(convs)
            got = {r["conv_id"]: r for r in chat_format.report(convs, paths, chars).collect()}
            assert set(got) == set(want)
            for c, (n, turns, loss_chars, loss_sha) in want.items():
                r = got[c]
                assert (r["n_turns"], r["loss_chars"]) == (n, loss_chars)
                if c != 4:  # ties of a turn are ordered, tested below
                    assert r["loss_sha256"] == loss_sha
                    assert r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in turns))
                assert r["formatted_chars"] == len(chat_format.render([(role, t) for _, role, t in turns])[0])
    assert -7 in got
    empty = spark.createDataFrame([], CONV)
    assert chat_format.report(empty, paths).count() == 0 and chat_format.report(chat_format.with_probe(empty), paths).count() == 1


def test_chat_parts_are_the_whole(spark):
    """The parts' ids in order are the ids of the whole text; masks and offsets hold on every part."""
    paths = packing.tokenizer_paths()
    convs, enc = odd_convs(spark), chat_format.ChatEncoder(*paths)
    whole = {}
    for r in chat_format.format_conversations(convs, paths, 300).orderBy("part").collect():
        text = r["formatted"].encode()
        bounds = [*r["offsets"], len(text)]
        for a, b, i, loss in zip(bounds, bounds[1:], r["ids"], r["loss"]):
            assert b - a == enc.lengths[i]
            assert not (loss and i >= chat_format.FIRST_CONTROL_ID)
        w = whole.setdefault(r["conv_id"], ["", [], 0])
        w[0] += r["formatted"]
        w[1] += r["ids"]
        w[2] += 1
    assert whole[7][2] > 10
    for text, ids, _ in whole.values():
        assert enc.ids(text).tolist() == ids
    tied = chat_format.parse(whole[4][0])
    assert tied[0] == ("user", "first") and tied.count(("assistant", "tie a")) == 2 and len(tied) == 4


def test_chat_encoders_agree():
    """The slow path has the same ids, and masks meet straddling tokens."""
    enc = chat_format.ChatEncoder(*packing.tokenizer_paths())
    text, _ = chat_format.render([("user", t or "") for t in NASTY] + [("assistant", " x" * 40)])
    fast = enc.ids(text).tolist()
    spaced = chat_format.render([("assistant", "\n" * 1_200_000)])[0]
    slow = enc.ids(spaced)
    assert enc.ends(slow)[-1] == len(spaced) and slow[0] == enc.controls["<s>"]
    assert enc.slow.encode(text, add_special_tokens=False).ids == fast
    starts, ends = np.array([0, 2, 4, 6]), np.array([2, 4, 6, 8])
    assert chat_format.loss_mask(starts, ends, [(1, 3), (6, 6), (7, 8)]).tolist() == [True, True, False, True]
    assert chat_format.loss_mask(starts, ends, [(2, 4), (4, 4)]).tolist() == [False, True, False, False]


# 13 --------------------------------------------------------------------------------------------

def brute_near(words):
    """By deletion: replaced words lose the same place to the same rest, shorter words are the longer one's rest."""
    near = {w: set() for w in words}
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((i, w[:i] + w[i + 1:]), []).append(w)
    for (_, rest), group in by.items():
        for a in group:
            near[a] |= {b for b in group if b != a}
            if rest in near:
                near[a].add(rest)
                near[rest].add(a)
    return near


def brute_variants(counts):
    near = brute_near(counts)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


def brute_words(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc(f"{'' if d is None else d}:{w}")
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def vocabulary():
    """Syllable words with their edits, anagrams, steps of five and very long words."""
    r = random.Random(11)
    words = {"".join(r.choice(["en", "eau", "la", "an", "é", "st", "aa"]) for _ in range(r.randrange(3, 7))) for _ in range(900)}
    for w in sorted(words)[:300]:
        at = r.randrange(len(w))
        words |= {w[:at] + w[at + 1:], w[:at] + r.choice("abÿ") + w[at:], w[:at] + "x" + w[at + 1:]}
    words |= {"a" * n for n in (6, 7, 9, 5_000, 5_001)} | {"a" * 4_999 + "b", "b" + "a" * 4_999, "ab" * 2_500, "ab" * 2_500 + "a"}
    counts = {w: r.choice([5, 6, 25, 30, 130, 700]) for w in words if len(w) >= 6}
    return counts | {"chaina" + "a" * i: 5 ** (i + 1) for i in range(9)}


def test_spelling_equals_brute_force(spark):
    counts = vocabulary()
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    for block in (spelling.BLOCK, 3):
        got = sorted((tuple(r) for r in spelling.group_variants(words, block).collect()), key=str)
        assert got == brute_variants(counts)
    assert {r[2] for r in got if r[0].startswith("chaina")} == {"chaina" + "a" * 8}


def test_spelling_report(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["garden", "gardens", "gArden", "morningé", "Étoile", "étoile", "stone", "lights", "škola", "x×y÷zab"])
                      for _ in range(300)) for _ in range(40)]
    for docs in (odd_docs(spark, texts), odd_docs(spark)):
        want = brute_variants(brute_words(rows_of(docs)))
        assert sorted((tuple(x) for x in spelling.report(docs).collect()), key=str) == want
    assert spelling.report(no_docs(spark)).count() == 0


def test_one_edit_and_distance():
    words = [w.encode("latin-1") for w in vocabulary() if len(w) < 100]
    near = brute_near(words)
    classes = {c: c % spelling.CLASSES for c in range(256)}
    found = set()
    for j, pair in enumerate(spelling.PAIRS):
        groups = {}
        for w in words:
            groups.setdefault(bytes(sorted(c for c in w if classes[c] in pair)), []).append((0, w))
        for g in groups.values():
            pairs = spelling.near_in_tile(str(j), g, classes)
            assert not found & set(pairs)  # a pair is found in one group
            found |= set(pairs)
    assert {(a, b) for a, b in found} | {(b, a) for a, b in found} == {(a, b) for a, bs in near.items() for b in bs}
