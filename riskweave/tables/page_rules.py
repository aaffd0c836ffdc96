"""Rule table of the web-page profile."""

# Rule ids and patterns in evaluation order, in the JavaScript
# dialect (ASCII word characters).

PAGE_BLOCKED = (
    ("base64_decode_to_shell",
     r"""(echo\s+['"]?[A-Za-z0-9+/=\s]{40,}['"]?\s*\|\s*base64\s+(-d|--decode)\s*\|\s*(/?bin/)?(ba)?sh)\b"""),
    ("base64_decode_to_shell2",
     r"""(base64\s+(-d|--decode)\s*.*?\|\s*(/?bin/)?(ba)?sh)\b"""),
    ("python_obfuscated_exec",
     r"""(python[23]?(?:\s+-c)?\s*['"].*?(?:base64|exec|eval|__import__)\s*.*?['"])"""),
    ("perl_obfuscated_exec",
     r"""(perl\s+-e\s*['"].*?(?:system|exec|eval)\s*.*?['"])"""),
    ("ruby_obfuscated_exec",
     r"""(ruby\s+-e\s*['"].*?(?:exec|eval|system)\s*.*?['"])"""),
    ("node_obfuscated_exec",
     r"""\bnode\s+-e\s*['"].*?(?:exec|eval)\s*.*?['"]"""),
    ("remote_fetch_to_shell",
     r"""\b(curl|wget|fetch)\b.*?\|\s*(?:/bin/)?(?:ba|z)?sh\b"""),
    ("remote_fetch_to_shell2",
     r"""\b(curl|wget|fetch)\b.*?(?:\s+\|\s+(sudo\s+)?(?:/bin/)?(?:ba|z)?sh|(?:bash|sh|zsh)\s+-c)"""),
    ("remote_fetch_chmod_execute",
     r"""\b(curl|wget|fetch)\b.*?\s+>\s+/tmp/\w+\s*&&\s*chmod\s*\+x\s+/tmp/\w+\s*(?:&&|;|\|\|)\s*\S*/tmp/\w+"""),
    ("browser_eval",
     r"""\beval\s*\(\s*['"][^'"]*(?:exec|system|cookie|localStorage|fetch|XMLHttpRequest|document\.write|child_process|require\s*\()[^'"]*['"]"""),
    ("browser_eval_alert_one",
     r"""\beval\s*\(\s*(['"])\s*alert\s*\(\s*1\s*\)\s*;?\s*\1\s*\)"""),
    ("browser_eval_document_location_external",
     r"""\beval\s*\(\s*(['"])\s*document\.location\s*=\s*(['"])https?://[^/'"\s)]+(?:/[^'"\s)]*)?\2\s*;?\s*\1\s*\)"""),
    ("browser_eval_simple",
     r"""\beval\s*\(\s*['"](?:\d+\s*[-+*/])\d+['"]\s*\)"""),
    ("browser_remote_fetch",
     r"""\b(fetch\s*\(\s*['"]https?://|XMLHttpRequest\s*\(|navigator\.sendBeacon\s*\(\s*['"]https?://)"""),
    ("browser_worker_remote",
     r"""\b(Worker\s*\(\s*['"]https?://|SharedWorker\s*\(\s*['"]https?://|importScripts\s*\(\s*['"]https?://)"""),
    ("browser_dom_injection",
     r"""\b(document\.write\s*\(|document\.body\.innerHTML\s*=)"""),
    ("credential_exfil",
     r"""\b(localStorage\s*\[\s*['"]apiKey|sessionStorage\s*\[\s*['"]apiKey|process\.env\s*\.\s*\w*[kK]ey\w*)"""),
    ("browser_credential_phishing",
     r"""\b(prompt\s*\(\s*['"]Please\s+enter\s+your\s+(?:password|token|key|secret)|confirm\s*\(\s*['"].*?(?:password|token|key|secret))"""),
    ("paste_jacking_instruction",
     r"""\b(paste\s+this\s+(?:command|code)\s+(?:into|in)\s+(?:your\s+)?(?:terminal|shell|console))\b"""),
    ("paste_jacking_instruction",
     r"""\b(copy\s+this\s+(?:command|code|script|text)\s+(?:and\s+)?(?:paste|run|execute)\s+it)\b"""),
    ("paste_jacking_instruction",
     r"""\b(copy\s+(?:and\s+)?paste\s+(?:this\s+)?(?:command|code|script|text))\b"""),
    ("paste_jacking_instruction",
     r"""\b(copy\s+(?:the\s+following\s+)?(?:command|code|script|text|this)\s+(?:into|in|to|inside)\s+(?:the\s+)?(?:your\s+)?(?:terminal|shell|console|command\s+line|prompt|window))\b"""),
    ("paste_jacking_instruction",
     r"""\b(paste\s+(?:the\s+following\s+)?(?:command|code|script|text)\s+(?:into|in|to)\s+(?:the\s+)?(?:your\s+)?(?:terminal|shell|console|command\s+line|prompt|window))\b"""),
    ("paste_jacking_instruction",
     r"""\b(run\s+this\s+(?:command|code)\s+in\s+(?:your\s+)?(?:terminal|shell|console))\b"""),
    ("paste_jacking_instruction",
     r"""\b(website|page|link|site|popup)\s+(?:told|asked|instructed|said|says|wants|tells)\s+(?:me|you|us|him|her)\s+(?:to\s+)?(?:copy|paste|run|execute|type|put|enter)\b"""),
    ("paste_jacking_instruction",
     r"""\b(?:copy|paste|run|execute|type|put|enter)\s+(?:this\s+)?(?:code|command|script|text|thing)?\s*(?:in|into|inside|to)\s+(?:the\s+)?(?:your\s+)?(?:terminal|shell|console|command[-\s]?line|prompt|window|box|field)\b"""),
    ("paste_jacking_instruction",
     r"""\b(put|type|enter|paste)\s+(?:this\s+)?(?:code|command|script|text|thing)?\s*(?:in|into|inside|to)\s+(?:the\s+)?(?:your\s+)?(?:command[-\s]?line|terminal|shell|console|prompt|window)\b"""),
    ("destructive_command",
     r"""\b(rm\s+-rf\s+/\s*$|rm\s+-rf\s+~\s*$|rm\s+-rf\s+\$HOME\s*$|rm\s+-rf\s+/\w+|rm\s+-rf\s+/\w+/\w+|mkfs\.|>:\s*\{\}\;|fork\s+bomb)\b"""),
    ("destructive_command2",
     r"""\b(rm\s+-rf\s+/|rm\s+-rf\s+~|rm\s+-rf\s+\$HOME)\s*$"""),
    ("destructive_command_option_permutation",
     r"""\brm\s+-(?=[a-z]*f)(?=[a-z]*r)[a-z]+\s+(?:/|~|\$HOME)\s*$"""),
    ("destructive_command3",
     r"""\b(dd\s+if=/dev/zero\s+of=/dev/[sh]d[a-z])\b"""),
    ("reverse_shell",
     r"""\bnc\s+-e\s+|netcat\s+-e\s+"""),
    ("reverse_shell2",
     r"""\b/dev/tcp/\d+\.\d+\.\d+\.\d+/\d+\s+\|\s*(ba)?sh\b"""),
    ("reverse_shell3",
     r"""(bash\s+-i\s+>&\s+/dev/tcp/)"""),
)

PAGE_SUSPICIOUS = (
    ("remote_fetch_to_interpreter",
     r"""\b(curl|wget|fetch)\b.*?\|\s*(python[23]?|perl|ruby|node)\b"""),
    ("remote_fetch_to_shell_s",
     r"""\b(curl|wget|fetch)\b.*?\s+\|\s*(sudo\s+)?(bash|sh)\s+-s\b"""),
    ("remote_fetch_tmp_executable",
     r"""\b(curl|wget|fetch)\b.*?\s+-o\s+/tmp/\w+\s*;\s*chmod\s*\+x"""),
    ("package_manager_pipe",
     r"""\b(pip|npm|gem|cargo)\s+install\s+[^\s]+\s*\|\s*(ba)?sh\b"""),
    ("base64_decode_without_shell",
     r"""\b(echo\s+['"]?[A-Za-z0-9+/=\s]{12,}['"]?\s*\|\s*base64\s+(-d|--decode))\b"""),
    ("encrypted_payload_to_shell",
     r"""\b(?:openssl|gpg)\s+enc\b.*?\|\s*(ba)?sh\b"""),
    ("eval_dynamic_exec",
     r"""\b(eval\s+['"]\$|exec\s+\$\(curl)"""),
    ("browser_dynamic_code",
     r"""\b(Function\s*\(\s*\)|new\s+Function\s*\(\s*['"].*?\)|setTimeout\s*\(\s*['"].*?\)|setInterval\s*\(\s*['"].*?\))"""),
    ("security_disable",
     r"""\b(disable\s+(?:security|gatekeeper|sip|sudoers|firewall|defender))\b"""),
    ("macos_security_disable",
     r"""\b(spctl\s+--master-disable|csrutil\s+disable)\b"""),
)

PAGE_SAFE_INSTALLERS = (
    r"""^https://hermes-agent\.nousresearch\.com/install\.sh$""",
    r"""^https://raw\.githubusercontent\.com/Homebrew/install/(?:HEAD|master)/install\.sh$""",
    r"""^https://ollama\.com/install\.sh$""",
    r"""^https://sh\.rustup\.rs$""",
    r"""^https://brew\.sh/install$""",
    r"""^https://raw\.githubusercontent\.com/NousResearch/hermes-agent/(?:main|master)/install\.sh$""",
    r"""^https://x\.ai/cli/install\.sh$""",
)
