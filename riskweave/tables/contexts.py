"""Context markers, downgrade rules, limits and vocabularies."""

# Markers that make a paste instruction reviewable, not dangerous.
SAFE_CONTEXT_MARKERS = (
    r"""\btest\s+(?:command|case|example|scenario|rule)\b""",
    r"""\bexample\s+(?:command|case|rule|test)\b""",
    r"""\btutorial\b""",
    r"""\bdocumentation\b""",
    r"""\bfor\s+(?:research|documentation|study|testing|education)\b""",
    r"""\bto\s+(?:understand|study|learn|defend|protect|research)\b""",
    r"""\bdefensive\s+(?:context|analysis|example|rule)\b""",
    r"""\bthe\s+rule\s+(?:for\s+)?['\"]""",
    r"""\bwe\s+(?:discussed|analyzed|audited|tested)\b""",
    r"""\bdo\s+not\s+(?:run|execute|copy|paste)\b""",
    r"""\bnever\s+(?:run|execute|copy|paste)\b""",
    r"""\bcopy\s+this\s+and\s+paste\s+it\s+into\s+(?:the\s+)?(?:your\s+)?(?:shell|terminal|console)\s+for\s+(?:the\s+)?(?:tutorial|documentation|example|test)""",
    r"""\bcopy\s+this\s+(?:command|code|script)\s+for\s+(?:the\s+)?(?:tutorial|documentation|example|test)""",
)
PAGE_SAFE_CONTEXT = (
    r"""\b(do\s+not|don't|never)\s+(?:actually\s+)?(?:run|execute|paste|copy)"""
    r"""|\bcopy\s+this\s+(?:and\s+)?paste\s+it\s+into\s+(?:the\s+)?(?:your\s+)?(?:shell|terminal|console)\s+for\s+(?:the\s+)?(?:tutorial|documentation|example|test)"""
)

# Which rule ids each downgrade applies to.
CONTEXT_ID_PARTS = ("paste", "copy_paste")
INSTALLER_ID_PREFIX = "remote_fetch_to_shell"
INSTALLER_IDS = ("paste_jacking_15", "bash_c_remote_fetch", "sh_c_remote_fetch")
PAGE_CONTEXT_ID = "paste_jacking_instruction"

# Reasons.
SAFE_CONTEXT_REASON = "explicit_safe_context_needs_review"
SAFE_INSTALLER_REASON = "known_safe_installer_needs_confirmation"
DECODED_SUFFIX = " (inside decoded payload)"
DECODED_SHELL_REASON = "decoded_base64_contains_shell_commands"
DECODED_SHELL_PATTERN = r"""\b(curl|wget|bash|sh|exec|eval)\b"""
TOO_LARGE_REASON = "input_too_large"
INPUT_ERROR_REASON = "guard_input_error"
PROTOCOL_ERROR_REASON = "guard_protocol_error"
TAMPERED_REASON = "phish_seed_blocklist_tampered_or_unsigned"

# Limits.
MAX_TEXT_BYTES = 1024 * 1024
MAX_CHAT_BYTES = 2 * 1024 * 1024
MAX_CHAT_DEPTH = 8
MAX_SARIF_BYTES = 32 * 1024 * 1024
MAX_SARIF_FINDINGS = 100_000
MAX_MESSAGE_CHARS = 4_096
STREAM_LOOKBACK = 200
BREAKER_MINUTES = 10
BREAKER_THRESHOLD = 3
KEEP_SNAPSHOTS = 7

# Vocabularies.
ACTIONS = ("SAFE", "SUSPICIOUS", "DANGEROUS")
ASSISTANT_ROLES = ("assistant", "model", "agent")
SEVERITIES = ("critical", "high", "medium", "low", "informational", "unknown")
SARIF_LEVELS = (("error", "high"), ("warning", "medium"), ("note", "low"), ("none", "informational"))
