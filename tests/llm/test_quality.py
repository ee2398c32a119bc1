from __future__ import annotations

import re
from collections import Counter

from covenantry.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n_repeat = len(covered)
    failed = len(words) < 10 or 100 * n_repeat > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), n_repeat, failed)


ODD = [
    (1, None), (2, ""), (3, "a b c d e"), (4, "a b c d e f " * 30), (5, "one two\none two\n\n \nthree\r\none two"), (6, "\x0b\x0cnbsp\xa0is part\t of words # * | &"),
    (7, "a b c d e f g h i j a b c d e k l m"), (7, "x y z w v " * 2 + " ".join(map(str, range(40)))), (None, "null id but text " + " ".join("abcdefghijkl")), (8, "w " * 30_000),
]


def test_figures_match_brute_force(documents, docs_of):
    for df in (documents, docs_of(ODD)):
        got = quality.judge(df).select(*quality.DIGEST).collect()
        rows = df.select("doc_id", "text").collect()
        want = sorted((str(r.doc_id), *figures(r.text)) for r in rows)
        assert sorted((str(r.doc_id), *tuple(r)[1:7]) for r in got) == want
        assert all(not (r.base_failed and r.kept) for r in got)
    assert quality.judge(docs_of([])).count() == 0


def test_lines_are_removed_and_documents_rejected(docs_of):
    prose = "The quick brown fox jumps over the lazy dog, and then it rests for a while."
    rows = [
        (1, f"{prose}\nHome | About | News | Contact\nAll rights reserved."),
        (2, "Home | About | News | Contact\nProducts | Prices | Blog | Help | Search | Login | Cart\nAll rights reserved."),
        (3, f"%%% ### $$$ &&& !!!\n{prose}"),
    ]
    got = {r.doc_id: r for r in quality.judge(docs_of(rows)).collect()}
    assert got[1].kept and got[1].clean_text == prose
    assert not got[2].kept and got[2].clean_text == ""
    assert got[3].kept and got[3].clean_text == prose


def test_plan_has_no_python_and_no_shuffle(documents):
    plan = quality.judge(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
