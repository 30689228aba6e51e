"""Conversation repair, license scans and cross-tokenizer alignment against brute force and literal cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import alignment, licenses
from quarry.llm import conversation_repair as cr

# -- 11 ------------------------------------------------------------------------


def brute(facts: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Every edit sequence with at most two insertions in a row, by plain recursion."""
    from functools import cache

    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i: int, last: str, inserted: int) -> tuple[int, str]:
        out = [(0, "")] if i == len(facts) and last in ("", "a") else []
        if inserted < 2:
            out += [(c + 3, "I" + a) for x in allowed[last] if x in "ua" for c, a in [best(i, x, inserted + 1)]]
        if i < len(facts):
            initial, must_go, cut = facts[i]
            c, a = best(i + 1, last, 0)
            out.append((c + 4, "D" + a))
            if not must_go:
                for x in allowed[last]:
                    if x == initial:
                        c, a = best(i + 1, x, 0)
                        out.append((c + 3 * cut, "K" + a))
                    elif x in "ua":
                        c, a = best(i + 1, x, 0)
                        out.append((c + 3 + 3 * cut, "R" + a))
        return min(out, default=(10**6, ""))

    return best(0, "", 0)


def _facts(rng: random.Random, n: int) -> list:
    return [(rng.choice("suuaaax "), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]


def test_search_finds_the_cheapest_least_audit():
    rng = random.Random(5)
    for _ in range(600):
        facts = _facts(rng, rng.randint(0, 9))
        assert cr.cheapest(facts) == brute(facts), facts


def test_blocks_join_to_the_whole():
    rng = random.Random(6)
    for _ in range(150):
        facts = _facts(rng, rng.randint(1, 24))
        size = rng.randint(1, 6)
        assert cr.cheapest_of_blocks([cr.crossings(facts[i : i + size]) for i in range(0, len(facts), size)]) == cr.cheapest(facts), facts


def test_literal_repairs():
    ok = lambda r: (r, False, False)
    assert cr.cheapest([]) == (0, "")
    assert cr.cheapest([ok("s"), ok("u"), ok("a")]) == (0, "KKK")
    assert cr.cheapest([ok("u")]) == (3, "KI")
    assert cr.cheapest([ok("s")]) == (4, "D")
    assert cr.cheapest([ok("u"), ok("u")]) == (3, "KR")
    assert cr.cheapest([("u", True, False), ok("u"), ("a", False, True)]) == (7, "DKK")


CONV = "conv_id long, turn long, role string, text string"


def _damaged(rows: list[tuple]) -> dict:
    out = defaultdict(list)
    show = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        out[conv] += []
        how = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        out[conv] += [(turn, role, text)] * (2 if how == 3 else 1)
    return out


def _expected(rows: list[tuple]) -> dict:
    out = {}
    for conv, turns in _damaged(rows).items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults, facts = set(), Counter(), []
        for _, role, text in turns:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            kind = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "ok"
            seen.add((role, text))
            faults[kind] += 1
            facts.append((role[:1], kind in ("blank", "duplicate"), kind == "truncated"))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = brute(tuple(facts))
        lines, last, at = [], "", iter(turns)
        for x in audit:
            turn = next(at) if x != "I" else None
            if x == "K":
                lines.append(f"{turn[1]}:{turn[2]}")
                last = turn[1][:1]
            elif x in "RI":
                last = "a" if last == "u" else "u"
                lines.append({"u": "user", "a": "assistant"}[last] + ":" + (turn[2] if turn else ""))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _conversations() -> list[tuple]:
    rng = random.Random(9)
    text = lambda: rng.choice(["Yes.", "No!", "what", "  ", "é ü?", "a.\n", "Why?\t", "same", "x" * rng.randint(1, 9) + "."])
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "tool", "", None]), text() if rng.random() < 0.95 else None) for c in range(60) for t in range(rng.randint(1, 9)) if rng.random() < 0.9]
    rows += [(None, t, "user" if t % 2 else "assistant", text()) for t in range(14)]
    rows += [(100, None, "user", "a."), (100, None, "user", "a."), (100, 3, "assistant", "b."), (100, 3, "assistant", "a."), (100, 3, "user", "a."), (101, None, "user", None)]
    rows += [(102, 0, "user", "again.")] * 3 + [(102, 1, "assistant", "again."), (102, 2, "user", "again."), (102, 7, "assistant", "long " * 3000 + ".")]
    return rows


@pytest.mark.parametrize("size", [1000, 4, 1])
def test_conversation_reports(spark, size):
    rows = _conversations()
    frame = spark.createDataFrame(rows, CONV).select("*", F.lit("x").alias("audit"), F.lit("x").alias("copies"), F.lit("x").alias("key"), F.lit("x").alias("how"))
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.report(spark, cr.damage(frame), size).collect()}
    assert got == _expected(rows)


@pytest.mark.parametrize("size", [1000, 4])
def test_repaired_turns_are_what_the_report_hashes(spark, size):
    damaged = cr.damage(spark.createDataFrame(_conversations(), CONV))
    turns = defaultdict(list)
    for r in cr.repair(spark, damaged, size).collect():
        turns[r["conv_id"]].append((r["position"], r["edit"], r["role"], r["text"]))
    for r in cr.report(spark, damaged, size).collect():
        mine = sorted(turns[r["conv_id"]])
        assert [t[0] for t in mine] == list(range(len(mine))) and re.fullmatch("(s?(ua)+)?", "".join(t[2][0] for t in mine))
        assert [t[1] for t in mine] == [x for x in r["audit"] if x != "D"]
        assert hashlib.sha256("\n".join(f"{t[2]}:{t[3]}" for t in mine).encode()).hexdigest() == r["repaired_sha256"]


def test_no_conversations(spark):
    none = spark.createDataFrame([], CONV)
    assert cr.report(spark, cr.damage(none)).count() == 0 and cr.repair(spark, cr.damage(none)).count() == 0


def test_conversation_sql(spark, tmp_path):
    rows = _conversations()
    spark.createDataFrame(rows, CONV).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = con.execute(cr.SQL).fetchall()
    assert {r[0]: tuple(r[1:]) for r in got} == _expected(rows)


# -- 12 ------------------------------------------------------------------------

DOCS = "doc_id long, text string"
LICENSED = [
    (1, "This work is licensed under the GNU General Public License, version 3."),
    (2, "Licensed under CC BY-NC 4.0."),
    (3, "Released under the MIT License."),
    (4, "Licensed under the Apache License, Version 2.0. Again: apache-license!"),
    (5, "SPDX-License-Identifier: BSD-3-Clause"),
    (6, "Ich komme mit. Die Lizenz license fehlt"),
    (7, None), (8, ""), (9, " .,- "), (3, "Released under the MIT License."), (None, "cc\x00by cc-by\tCC BY"),
    (10, "words " * 20_000 + "mit license " * 3_000 + "the end"),
    (11, "GNU Lesser General Public License v2.1, all rights reserved; MPL 2.0 license. Éa gnu General\nPUBLIC licenseé"),
    (12, "creative commons attribution non commercial share alike 4.0"),
]


def _scan(spark, rows=LICENSED, **extra):
    frame = spark.createDataFrame(rows, DOCS).select("*", *(F.lit("x").alias(c) for c in "row found rule label n_words first _spaced".split()))
    return licenses.summary(*licenses.license_scan(spark, frame))


def test_licenses_of_literal_texts(spark):
    got = defaultdict(list)
    for r in _scan(spark).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    assert got[1] == [(12, 1, 6, 6, "gpl", "gpl,gpl-3.0", 1.0)]
    assert got[2][0][:5] == (7, 1, 2, 2, "cc-by") and got[2][0][5] == "cc-by,cc-by-nc-4.0"
    assert got[3] == [(5, 1, 3, 3, "mit", "mit", 1.0)] * 2
    assert got[4] == [(11, 2, 3, 9, "apache", "apache,apache-2.0", 1.0)]
    assert got[5] == [(6, 0, None, None, "", "bsd-3-clause", 1.0)]
    assert [x[5:] for x in got[6]] == [("", 0.0)]
    assert got[7] == got[8] == got[9] == [(0, 0, None, None, "", "", 0.0)]
    assert got[None] == [(6, 3, 0, 4, "cc-by", "cc-by", 1.0)]
    assert got[10] == [(26_002, 3000, 20_000, 25_998, "mit", "mit", 1.0)]
    assert got[11][0][4:6] == ("", "lgpl-2.1,mpl-2.0,proprietary")
    assert got[12][0][5] == "cc-by-nc-sa-4.0"


def test_suppression_by_containment():
    assert len(licenses.RULES) > 300 and [r[0] for r in licenses.RULES] == list(range(len(licenses.RULES)))
    for _, _, keys, rx, _, _ in licenses.RULES:  # what a rule can match has its first keyword
        required = re.sub(r"\(\?: .*? \)\?", "", rx)
        assert keys[0] in ("licen", "spdx") or re.search(re.escape(keys[0].strip().split("  ")[0]), required), rx


def test_detections_against_pairs(spark):
    """The window's suppression equals a comparison of all pairs, over random spans."""
    rng = random.Random(3)
    spans = [(d, rng.randrange(len(licenses.RULES)), a := rng.randint(0, 12), a + rng.randint(0, 6)) for d in range(40) for _ in range(rng.randint(1, 9))]
    spans = list({(d, r, a): (d, r, a, z) for d, r, a, z in spans}.values())
    frame = spark.createDataFrame(spans, "row long, rule int, first long, last long")
    got = {(r["row"], r["rule"], r["first"]): r["kept"] for r in licenses.detections(spark, frame, "row").collect()}
    rank = {i: p for i, _, _, _, p, _ in licenses.RULES}
    base = {i for i, *_, b in licenses.RULES if b}
    for d, r, a, z in spans:
        inside = any(e == d and b <= a and y >= z and (rank[q] > rank[r] or rank[q] == rank[r] and (y - b > z - a or y - b == z - a and q < r)) for e, q, b, y in spans)
        assert got[d, r, a] == (r in base or not inside), (d, r, a, z)


def test_licenses_against_sql(spark, tmp_path):
    spark.createDataFrame(LICENSED, DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE doc_id <> 10")
    want = con.execute(licenses.SQL).fetchall()
    got = [tuple(r) for r in _scan(spark).filter("doc_id <> 10").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert _scan(spark, []).count() == 0


# -- 13 ------------------------------------------------------------------------

ODD = [
    "a", "x  y", "x\n  y", "x\n y", " lead", "trail ", "  x    y", "é è  à", "日本語 テキスト  混", "▁ab c", "a<|endoftext|> b <s> </s><0x41>", "🙂🙂 👩‍👩‍👧 z", "\t\ttab\r\n  x",
    "1234567890" * 20, "x" * 300, "don't  I'll 's", "　 a  b\x85 c", "\x00 z\x01", "a" * 5 + "é" * 100 + "ß" * 50, "ǆ ﬁ Å", "á e", "##### ***** %%%%", " " * 50 + "x", "\n\n\n  \n x",
    " ", "   ", "a ", "a  ", "\n ", "  \n", "▁", "the same words the same words", "the same words the same words", "é" * 3000 + " end", "words and more words " * 400,
]


class Plain:
    """Both tokenizers by their own libraries, aligned token by token."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(alignment.A_FILE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
        self.letters = alignment._byte_level()

    def align(self, text):
        full = (" " + text).encode()
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        spell_a = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in a]
        spell_b = [bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(self.b.id_to_piece, b)]
        if b"".join(spell_a) != full or b"".join(spell_b) != full:
            return 0, 0, 0, 0, "", Counter()
        ends = lambda xs: [sum(map(len, xs[: i + 1])) for i in range(len(xs))]
        ea, eb, x, y, groups, links = ends(spell_a), ends(spell_b), 0, 0, [], Counter()
        for e in sorted(set(ea) & set(eb)):
            i, j = ea.index(e) + 1, eb.index(e) + 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            links.update((p, q) for p in a[x:i] for q in b[y:j])
            x, y = i, j
        return len(a), len(b), len(groups), links.total(), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def _table():
    rows = [(i, t) for i, t in enumerate(ODD)] + [(200, None), (201, ""), (None, "no id"), (0, "a"), (300, ODD[-1]), (301, ODD[-1])]
    return rows


def _measures(rows):
    plain = Plain()
    per = {t: plain.align(t) for t in {t for _, t in rows if t}}
    count = Counter()
    for _, t in rows:
        count.update(per[t][5].keys() if t else ())
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for i, t in rows:
        if not t:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, ng, nl, sha, links = per[t]
        out.append((i, na, nb, ng, nl, sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()), sha))
    return out


@pytest.mark.parametrize("block", [alignment.PAIR_BLOCK, 40])
def test_alignment_against_the_libraries(spark, block):
    rows = _table()
    frame = spark.createDataFrame(rows, DOCS).select("*", *(F.lit("x").alias(c) for c in "tid text_sha pairs times n_a n_docs pair best n".split()))
    got = [tuple(r) for r in alignment.align(spark, frame, block=block).collect()]
    assert sorted(map(str, got)) == sorted(map(str, _measures(rows)))


def test_wide_groups_and_equal_hashes(monkeypatch):
    want = alignment.align_slice(ODD)
    monkeypatch.setattr(alignment, "WIDE_GROUP", 3)
    monkeypatch.setattr(alignment.at, "byte_hashes", lambda data, starts, lens: starts * 0)
    got = alignment.align_slice(ODD)
    for k in want:
        assert list(want[k]) == list(got[k]), k


def test_nothing_to_align(spark):
    assert alignment.align(spark, spark.createDataFrame([], DOCS)).count() == 0
    assert [tuple(r) for r in alignment.align(spark, spark.createDataFrame([(1, None), (2, "")], DOCS)).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
