from __future__ import annotations

import random
import re

from covenantry.llm import quotes
from tests.oracle import compare

SCHEMA = "conv_id long, turn long, role string, text string, thread string, hash long"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return {(r.conv_id, r.turn): r for r in quotes.format_chat(df).collect()}


def test_quotes_link_to_the_first_author(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nAnd a dict, too?"),
        (1, 1, "assistant", "On Monday, a user wrote:\n> How do I sort a list?\n\nUse sorted()."),
        (1, 2, "user", "> > How do I sort a list?\n> Use sorted().\n\nThat works; what about reverse order?"),
        (1, 3, "user", "Something else entirely."),
        (1, 4, "assistant", ">And   a DICT,\n>too?\nSort its items."),
        (1, 5, "assistant", "> never said by anyone\nHm."),
        (2, 0, "user", "> How do I sort a list?\nAnother conversation."),
        (2, 7, "user", "> said later\nText"),
        (2, 8, "user", "said later"),
    ]
    got = run(spark, rows)
    assert {k: r.reply_to for k, r in got.items() if r.reply_to is not None} == {(1, 1): 0, (1, 2): 1, (1, 4): 0}
    assert got[1, 1].text == "Use sorted()." and got[1, 2].text == "That works; what about reverse order?" and got[1, 4].text == "Sort its items."
    assert [(got[1, t].thread, got[1, t].depth) for t in range(6)] == [(0, 0), (0, 1), (0, 2), (3, 0), (0, 1), (5, 0)]
    assert got[1, 2].formatted == "<|user|>\nThat works; what about reverse order?\n<|end|>\n" and got[1, 2].n_quoted_lines == 2
    order = sorted((r.thread, r.turn) for k, r in got.items() if k[0] == 1)
    assert [t for _, t in order] == [0, 1, 2, 4, 3, 5]


def test_long_chain(spark):
    rows = [(1, k, "user", (f"> message number {k - 1}\n" if k else "") + f"message number {k}") for k in range(40)]
    got = run(spark, rows)
    assert all(got[1, k].thread == 0 and got[1, k].depth == k for k in range(40))


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, 0, "user", "a b"), (None, 1, "user", "> a b\nc"), (1, None, "x", "> a"), (1, 0, None, None), (1, 1, "user", ""), (2, 0, "user", "q r"), (2, 1, "user", "> q r\ns"), (2, 1, "user", "> q r\ns"), (3, 0, "u", "line\n" * 20_000), (3, 1, "u", "<|end|> > not a quote")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = quotes.format_chat(df).collect()
    assert len(got) == len(rows)
    assert sorted(r.reply_to for r in got if r.reply_to is not None) == [0, 0]
    assert {r.role for r in got if (r.conv_id, r.turn) == (1, 0)} == {"unknown"}
    assert "<|end|> >" not in next(r.formatted for r in got if (r.conv_id, r.turn) == (3, 1))
    assert quotes.format_chat(df.limit(0)).count() == 0


def test_whole_table_has_a_row_per_message(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    out = quotes.format_chat(table)
    assert sorted((r.conv_id, r.turn, r.role) for r in out.collect()) == sorted((r.conv_id, r.turn, r.role) for r in table.collect())
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def brute(rows):
    """(conv, turn) -> (own text, reply_to, thread, depth, place), message by message."""
    quote = re.compile(r"^[ \t]*>(?:[ \t]*>)*")
    norm = lambda x: " ".join(re.sub(r"[\W_]+", " ", x.lower()).split())

    def units(text):
        parts = text.split("\n") + re.split(r"(?<=[.!?]) ", re.sub(r"\s+", " ", text))
        return {norm(x) for x in parts} - {""}

    talks = {}
    for conv, turn, _, text in rows:
        lines = [(len(re.findall(">", m[0])), x[m.end() :].strip(" ")) if (m := quote.match(x)) else (0, x) for x in (text or "").split("\n")]
        talks.setdefault(conv, {})[turn] = lines
    out = {}
    for conv, talk in talks.items():
        own = {t: "\n".join(x for k, x in lines if k == 0).strip() for t, lines in talk.items()}
        reply = {}
        for t, lines in talk.items():
            for level in sorted({k for k, _ in lines} - {0}):
                weight = {}
                for u in units("\n".join(x for k, x in lines if k == level)):
                    first = min((s for s in talk if u in units(own[s])), default=None)
                    if first is not None and first < t:
                        weight[first] = weight.get(first, 0) + len(u)
                if weight:
                    reply[t] = max(weight, key=lambda s: (weight[s], s))
                    break

        def root(t, reply=reply):
            depth = 0
            while t in reply:
                t, depth = reply[t], depth + 1
            return t, depth

        def walk(t, reply=reply):
            yield t
            for s in sorted(s for s in reply if reply[s] == t):
                yield from walk(s)

        place = {t: k for r in {root(t)[0] for t in talk} for k, t in enumerate(walk(r))}
        for t in talk:
            out[conv, t] = (own[t], reply.get(t), *root(t), place[t])
    return out


def made_threads():
    draw = random.Random(9)
    rows = []
    for conv in range(25):
        said = []
        for turn in range(draw.randint(1, 14)):
            own = f"Message {conv} {draw.randint(0, 30)} says so. And more of {turn}!"
            quoted = ""
            if said and draw.random() < 0.75:
                old = draw.choice(said)
                passage = draw.choice([old, old.split(". ")[0] + ".", old.upper()])
                quoted = "\n".join("> " * draw.choice([1, 1, 2]) + x for x in passage.split("\n")) + "\n"
                if draw.random() < 0.4:
                    quoted += "> > " + draw.choice(said) + "\n"
            said.append(own)
            rows.append((conv, turn * 3, "user", quoted + own))
    return rows


def test_made_threads_against_brute_force(spark):
    rows = made_threads()
    got = run(spark, rows)
    want = brute(rows)
    assert {k: (r.text, r.reply_to, r.thread, r.depth, r.place) for k, r in got.items()} == want
    assert max(w[3] for w in want.values()) >= 3 and sum(w[1] is not None for w in want.values()) > 60


def test_conversations_come_depth_first(spark):
    rows = [(1, 0, "u", "first one"), (1, 1, "u", "> first one\nanswer a"), (1, 2, "u", "> first one\nanswer b"), (1, 3, "u", "> answer a\nanswer c"), (1, 4, "u", "apart"), (1, 5, "u", "> answer b\nanswer d")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert [r.turn for r in quotes.conversations(df).collect()] == [0, 1, 3, 2, 5, 4]


def test_made_threads_match_the_sql(spark, tmp_path):
    df = spark.createDataFrame([(*r, "clash", 1) for r in made_threads()] + [(1, 99, None, None, "clash", 1), (None, 1, "u", "> x", "clash", 1)], SCHEMA)
    df.toPandas().astype({"conv_id": "Int64"}).to_parquet(tmp_path / "conversations.parquet")
    compare(spark, str(tmp_path), lambda s, d: quotes.conversations(df), quotes.oracle_sql())
