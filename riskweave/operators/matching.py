"""Rule matching: which rules hit a text, where, and what they matched.

The rules of a book are unrolled into one projection. A rule's regex runs only
if the text holds the literals the rule cannot match without. A small set of
words that covers every rule is searched once per text (byte searches on the
folded text), and only in texts that hold one of a few symbols or of the words of
the rules without a symbol; a rule's further literals are searched only when its
first ones were found. Spans are cut out afterwards, for hits only, by a pattern looked up
per hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import literal_groups, python_to_java, with_prefix_group
from ..functions.linear import linear_form
from ..functions.normalize import canonicalize_shell, fold, normalize_corpus
from .rules import RuleBook, default_rules

Group = tuple[str, ...]


def _rank(group: Group):
    """Telling groups first: long literals, few alternatives."""
    return (-min(len(word) for word in group) / len(group) ** 0.5, group)


# Words too common in prose to tell texts apart; used only if a rule has no others.
_COMMON = frozenset(
    "the this with into inside in to it me you us him her run put type enter get open start mode system text code "
    "key page link site post send box field".split())


def _cover(rules: list[list[Group]]) -> list[str]:
    """Few words such that every guarded rule has a group made of them."""
    words: set[str] = set()

    def covered(groups):
        return any(set(group) <= words for group in groups)

    def gain(group):
        fresh = len(set(group) - words)
        return (sum(group in groups for groups in open_rules) / fresh, min(map(len, group)), group)

    open_rules = [groups for groups in rules if groups]
    while open_rules:
        every = {group for groups in open_rules for group in groups}
        strong = {group for group in every if not _COMMON & set(group) and min(map(len, group)) >= 3}
        words.update(max(strong or every, key=gain))
        open_rules = [groups for groups in open_rules if not covered(groups)]
    return sorted(words)


class GuardedRules:
    """Sections of rules behind one shared set of words."""

    def __init__(self, sections: dict[str, list[str]], *, to_java=python_to_java, guarded: bool = True):
        self.java = {name: [to_java(p) for p in patterns] for name, patterns in sections.items()}
        # Whether a rule hits is asked in its linear form; the texts hold no line feeds.
        self._tests = {name: [to_java(linear_form(p)) for p in patterns] for name, patterns in sections.items()}
        self._groups = {
            name: [sorted(set(literal_groups(p)), key=_rank) if guarded else [] for p in patterns]
            for name, patterns in sections.items()
        }
        self.words = _cover([groups for part in self._groups.values() for groups in part])
        self._slot = {word: i for i, word in enumerate(self.words)}

    def word_tests(self, folded: str) -> Column:
        """One boolean per shared word of the folded text in column ``folded``; NULL
        for a text without any, which no guarded rule can match."""
        if not self.words:
            return F.expr("cast(null as array<boolean>)")
        tests = [f"contains({folded}, {sql_text(word)})" for word in self.words]
        return F.expr(f"CASE WHEN {' OR '.join(tests)} THEN array({', '.join(tests)}) END")

    def _any(self, group: Group, folded: str, found: str) -> str:
        return "(" + " OR ".join(
            f"get({found}, {self._slot[word]})" if word in self._slot else f"contains({folded}, {sql_text(word)})"
            for word in group
        ) + ")"

    def _guards(self, name: str, i: int, folded: str, found: str) -> list[str]:
        groups = self._groups[name][i]
        known = [g for g in groups if all(word in self._slot for word in g)]
        rest = [g for g in groups if g not in known]
        return [self._any(group, folded, found) for group in known + rest]

    def _test(self, name: str, i: int, text: str, folded: str, found: str) -> str:
        return " AND ".join([*self._guards(name, i, folded, found), f"rlike({text}, {sql_text(self._tests[name][i])})"])

    def _skip(self, name: str, found: str) -> str:
        """The condition under which no rule of the section can match."""
        return f"{found} IS NULL" if all(self._groups[name]) else "false"

    # The unrolled rules are thousands of nodes, so they are written as SQL text
    # and parsed once instead of being built call by call.
    def hits(self, name: str, text: str, folded: str, found: str) -> Column:
        """Positions (from 1) of the rules that match column ``text``, ascending.

        array_compact is a higher-order function, which keeps the projection out
        of whole-stage code: all rules in one method would pass the JVM's limit.
        """
        tests = [f"CASE WHEN {self._test(name, i, text, folded, found)} THEN {i + 1} END"
                 for i in range(len(self.java[name]))]
        return F.expr(f"CASE WHEN {self._skip(name, found)} THEN cast(array() as array<int>) "
                      f"ELSE array_compact(array({', '.join(tests)})) END")

    def may_hit(self, name: str, at: list[int], folded: str, found: str) -> Column:
        """Whether the literals of one of the rules at the given places (from 0) are there."""
        guards = [" AND ".join(self._guards(name, i, folded, found)) or "true" for i in at]
        return F.expr(f"CASE WHEN {self._skip(name, found)} THEN false ELSE {' OR '.join(f'({x})' for x in guards) or 'false'} END")

    def first_of(self, name: str, open_if: dict[int, str], text: str, folded: str, found: str) -> Column:
        """Position (from 1) of the first rule that matches among those given (from 0), each under its SQL condition;
        later rules are not tried."""
        tests = [f"WHEN {condition} AND {self._test(name, i, text, folded, found)} THEN {i + 1}" for i, condition in sorted(open_if.items())]
        return F.expr(f"get(array_compact(array(CASE WHEN {self._skip(name, found)} THEN NULL {' '.join(tests)} END)), 0)")

    def hits_of(self, name: str, open_if: dict[int, str], text: str, folded: str, found: str, last: str) -> Column:
        """Like `hits`, for the rules given (from 0), each under its SQL condition and only before position ``last``,
        which ends the list; all rules if it is NULL."""
        tests = [f"CASE WHEN {condition} AND ({last} IS NULL OR {last} > {i + 1}) AND {self._test(name, i, text, folded, found)} THEN {i + 1} END"
                 for i, condition in sorted(open_if.items())]
        return F.expr(f"CASE WHEN {self._skip(name, found)} THEN cast(array() as array<int>) "
                      f"ELSE array_compact(array({', '.join([*tests, last])})) END")

    def first(self, name: str, values: list[str], text: str, folded: str, found: str) -> Column:
        """The value of the first rule that matches; later rules are not tried."""
        tests = [f"WHEN {self._test(name, i, text, folded, found)} THEN {sql_text(value)}"
                 for i, value in enumerate(values)]
        return F.expr(f"CASE WHEN {self._skip(name, found)} THEN NULL {' '.join(tests)} END")


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def guarded_rules(rules: RuleBook, names, *, guarded: bool = True) -> GuardedRules:
    return GuardedRules({name: [p for _, p in rules.section(name)] for name in names}, guarded=guarded)


def literal_array(values) -> Column:
    """A constant array of strings, folded to one literal by the optimizer."""
    return F.expr(f"array({', '.join(sql_text(value) for value in values)})")


def span(text: Column, pattern: Column, group: int = 0) -> Column:
    return F.call_function("regexp_extract", text, pattern, F.lit(group))


FINDING_SCHEMA = "section string, ord int, rule_id string, start int, matched string"


def match_rules(df: DataFrame, rules: RuleBook | None = None, *, text_col: str = "text",
                keys: list[str], sections=("bounty_spam", "blocked", "suspicious"),
                unicode_forms: bool = True, guarded: bool = True) -> DataFrame:
    """All matches as rows ``(*keys, section, ord, rule_id, start, matched)``.

    ``start`` counts code points in the normalised text, from 0. The plan is one
    scan, projections and a Generate; nothing is shuffled.
    """
    rules = rules or default_rules()
    df = df.select(*keys, F.col(text_col).alias("_text"))
    df = canonicalize_shell(normalize_corpus(df, "_text", "_norm", unicode_forms=unicode_forms), "_norm")
    df = df.select(*keys, "_norm", fold(F.col("_norm")).alias("_fold"))
    text, names = F.col("_norm"), ("_norm", "_fold", "_found")
    matcher = guarded_rules(rules, sections, guarded=guarded)
    df = df.withColumn("_found", matcher.word_tests("_fold"))
    df = df.select(*keys, "_norm", *[
        matcher.hits(name, *names).alias(f"_h_{name}") for name in sections])

    def rows(name: str) -> Column:
        ids = literal_array(rule_id for rule_id, _ in rules.section(name))
        plain = literal_array(matcher.java[name])
        prefixed = literal_array(with_prefix_group(p) for p in matcher.java[name])

        def one(i):
            at = i - 1
            return F.struct(
                F.lit(name).alias("section"), i.alias("ord"), F.get(ids, at).alias("rule_id"),
                F.length(span(text, F.get(prefixed, at), 1)).alias("start"),
                span(text, F.get(plain, at)).alias("matched"),
            )
        return F.transform(F.col(f"_h_{name}"), one)

    return df.select(*keys, F.inline(F.concat(*[rows(name) for name in sections])))
