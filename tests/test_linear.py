"""Linear forms of rules: equal to the rules on random texts, and linear on texts of many beginnings."""

from __future__ import annotations

import random
import re
import time
from re import _constants as sre
from re import _parser as sre_parser

import pytest

from riskweave.functions.dialect import python_to_java
from riskweave.functions.linear import _written, linear_form
from riskweave.operators.verdicts import classify_corpus
from riskweave.tables import line_rules, page_rules, shell_rules

RULES = [*shell_rules.BLOCKED, *shell_rules.SUSPICIOUS, *shell_rules.BOUNTY_SPAM, *line_rules.LINE_RULES, *page_rules.PAGE_BLOCKED,
         *page_rules.PAGE_SUSPICIOUS]
FILL = "ab1 .-_/'\"|;&><=()$~\\{}"


def sample(items, rng) -> str:
    """A random text that the parsed items match."""
    out = []
    for op, arg in items:
        if op is sre.LITERAL:
            out.append(chr(arg))
        elif op in (sre.ANY, sre.IN, sre.NOT_LITERAL):
            test = re.compile(_written([(op, arg)]), re.IGNORECASE)
            out.append(rng.choice([c for c in FILL + "xyzABC09+,:#" if test.fullmatch(c)] or ["x"]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            for _ in range(min(arg[0] + rng.choice((0, 0, 1, 2)), arg[1])):
                out.append(sample(arg[2], rng))
        elif op is sre.SUBPATTERN:
            out.append(sample(arg[3], rng))
        elif op is sre.BRANCH:
            out.append(sample(rng.choice(arg[1]), rng))
        elif op is sre.GROUPREF:
            out.append("'")
    return "".join(out)


def texts_for(pattern, rng, n):
    """Matches of the pattern, whole, cut and with pieces lost, in a row."""
    parsed = sre_parser.parse(pattern, re.IGNORECASE)
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            text = sample(parsed, rng)
            i, j = sorted(rng.randrange(len(text) + 1) for _ in range(2))
            parts.append(rng.choice((text, text[i:j], text[:i] + text[j:])))
            parts.append("".join(rng.choice(FILL) for _ in range(rng.randint(0, 4))))
        yield "".join(parts).replace("\n", " ")


def test_forms_equal_their_rules_on_random_texts():
    rng, changed, hits, asked = random.Random(7), 0, 0, 0
    for _, pattern in RULES:
        form = linear_form(pattern)
        if form == pattern:
            continue
        changed += 1
        rule, test = re.compile(pattern, re.IGNORECASE), re.compile(form, re.IGNORECASE)
        for text in texts_for(pattern, rng, 150):
            hits, asked = hits + bool(rule.search(text)), asked + 1
            assert bool(rule.search(text)) == bool(test.search(text)), (pattern, form, text)
    assert changed > 80 and asked // 4 < hits < asked


def test_java_agrees(spark):
    rng, rows = random.Random(8), []
    for _, pattern in RULES:
        form = linear_form(pattern)
        if form != pattern and "(?<!" not in pattern:
            rows += [(python_to_java(pattern), python_to_java(form), text) for text in texts_for(pattern, rng, 12)]
    df = spark.createDataFrame(rows, "rule string, form string, text string").repartition(8)
    assert df.selectExpr("text rlike rule as a", "text rlike form as b").filter("a <> b").count() == 0


@pytest.mark.parametrize("pattern", [
    r"ab.*?cb", r"a.*?b.*?c", r"(ab|abc).*?d", r"a+.*?b", r"(?:x|y z)\s+.*?end", r"a[^|]*\|b", r"(a.*?b|c)d", r"ab?.*?c", r"a(?:bc)?[a-d]{3,}e",
    r"\ba\b.*?\bb\b", r"a.*b", r"aa.*?aa", r"aba.*?b", r"x(?![a-z ]*stop)", r"<[^>]+>b", r"(a|b|ab).*?ba", r"[ab]{2}.*?c", r"a\s*b\s*.*?\s*c"])
def test_small_patterns_on_all_short_texts(pattern):
    """Also those for which a naive form would be wrong: overlapping or longer first parts."""
    rng = random.Random(pattern)
    rule, form = re.compile(pattern, re.IGNORECASE), re.compile(linear_form(pattern), re.IGNORECASE)
    for _ in range(4000):
        text = "".join(rng.choice("aabbcde|<> xyzstop") for _ in range(rng.randint(0, 12)))
        assert bool(rule.search(text)) == bool(form.search(text)), (linear_form(pattern), text)


BEGINNINGS = [
    "curl http://a -o /tmp/x ", "wget | base64 -d ", "python -c ' eval ", "perl -e ' exec ", "node -e ' eval ", "bash -c ' curl ", "echo aaaa base64 ",
    "copy this code paste ", "you should open irc ", "connect with hackers ", "confirm(' eval(' ", "openssl enc base64 ", "new Function(' setTimeout(' "]
ENDS = " | sh base64 -d | paste into exec curl irc handler in the report ) <a"


def longest_seconds(spark, chars: int) -> float:
    """The slowest of one-row texts made of one beginning each."""
    worst = 0.0
    for beginning in BEGINNINGS:
        text = ENDS[:-3] + beginning * (chars // len(beginning))
        df = spark.createDataFrame([(1, text)], "id int, text string")
        t0 = time.time()
        classify_corpus(df, keys=["id"]).collect()
        worst = max(worst, time.time() - t0)
    return worst


def test_long_rows_of_beginnings_are_linear(spark):
    """80 kB of beginnings cost about what planning costs."""
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    classify_corpus(df, keys=["id"]).collect()
    t0 = time.time()
    classify_corpus(df, keys=["id"]).collect()
    planning = time.time() - t0
    assert longest_seconds(spark, 80_000) < planning + 2
