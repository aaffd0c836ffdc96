"""Line rules for scripts, documents and data files (first match per line wins)."""

# Fixed values: (risk, pattern) pairs in evaluation order.

LINE_RULES = (
    ("pipe remote download straight into an interpreter",
     r"""curl[^|\n]*\|\s*(sudo\s+)?(bash|sh|zsh|python3?|perl|ruby)\b"""),
    ("pipe remote download straight into an interpreter",
     r"""wget[^|\n]*\|\s*(sudo\s+)?(bash|sh|zsh|python3?|perl|ruby)\b"""),
    ("download script to file then execute it",
     r"""(curl|wget)[^\n]*https?://[^\n]*(-o|-O|>)\s*\S+\.(sh|bash|py|pl|rb)\b[^\n]*(&&|;|\n)\s*(sudo\s+)?(bash|sh|zsh|python3?|perl|ruby|chmod\s*\+x)"""),
    ("download then chmod/run in one line",
     r"""(curl|wget)[^\n]*https?://[^\n]*(&&|;)[^\n]*(chmod\s*\+x|bash\s|sh\s|python3?\s|\./|/tmp/)"""),
    ("urlopen fetch",
     r"""urllib\.request\.urlopen\([^\n]*\)\.read\(\)[^\n]*\)?\s*\)?\s*;?\s*$"""),
    ("exec() of urlopen-fetched remote content",
     r"""exec\s*\(\s*(urllib\.request\.)?urlopen\("""),
    ("perl download then system() run",
     r"""getstore\([^\n]*\)\s*;\s*system\("""),
    ("base64-decode piped to an interpreter (paste-jack)",
     r"""base64\s+(-d|--decode|-D)[^|\n]*\|\s*(bash|sh|zsh|python3?)\b"""),
    ("base64-decode to file then run",
     r"""base64\s+(-d|--decode|-D)[^\n]*>\s*\S+[^\n]*(;|&&)[^\n]*(bash|sh|zsh|python3?)\s"""),
    ("python exec() of base64-decoded payload",
     r"""exec\s*\(\s*base64\.b64decode\("""),
    ("eval/exec of __import__('base64').b64decode payload",
     r"""(eval|exec)\s*\(\s*__import__\(\s*['\"]base64['\"]\s*\)\.b64decode\("""),
    ("eval/exec of remotely-fetched content",
     r"""(eval|exec)\s*\(\s*(requests\.(get|post)|urllib\.request\.urlopen|urlopen)\s*\("""),
    ("eval/exec of HTTP response body",
     r"""(eval|exec)\s*\(\s*\w+\.(get|post)\([^)]*\)\.(text|content|read\(\))\s*\)"""),
    ("openssl base64 decode piped to shell",
     r"""openssl\s+enc\s+-base64\s+-d[^\n]*\|\s*(bash|sh|zsh)\b"""),
    ("hex-obfuscated command rebuilt and executed",
     r"""printf[^\n]*\\x[0-9a-f]{2}[^\n]*\|\s*xargs[^\n]*sh\s+-c"""),
    ("bash reverse shell over /dev/tcp",
     r"""bash\s+-i\s+>&\s*/dev/tcp/"""),
    ("netcat -e exec shell",
     r"""\bnc(at)?\s+(-\S*\s+)*-e\s+/(bin/)?(sh|bash)"""),
    ("python reverse shell (socket+dup2)",
     r"""socket\.socket\(\)[^\n]*connect\([^\n]*\)[^\n]*(dup2|pty\.spawn|/bin/sh)"""),
    ("mkfifo netcat shell relay",
     r"""mkfifo[^\n]*\|[^\n]*(/bin/)?(sh|bash)[^\n]*\|[^\n]*nc(at)?\s"""),
    ("socat reverse shell",
     r"""socat\s+exec:[^\n]*(bash|sh)[^\n]*tcp:"""),
    ("destructive rm of root/home/everything",
     r"""\brm\s+(-[a-z]*[rf][a-z]*\s+)+(/\s*$|/\s|~\s*$|~/\s*\*|$HOME\s*$|\.\s*$|\*\s*$|\S+/\s*$)"""),
    ("destructive filesystem command",
     r"""(os\.system|subprocess[.\w]*)\s*\(\s*['\"][^'\"]*(rm\s+-rf\s+/|mkfs|dd\s+if=)"""),
    ("format a device",
     r"""\bmkfs(\.\w+)?\s+/dev/"""),
    ("raw write over a disk device",
     r"""\bdd\s+if=/dev/(zero|random|urandom)\s+of=/dev/(disk|sd|nvme)"""),
    ("find-and-delete under home",
     r"""\bfind\s+~\s+[^\n]*-delete\b"""),
    ("lockout chmod on keys/home",
     r"""chmod\s+-R\s+0{3}\s+[^\n]*(\.ssh|\.gnupg|~|/)"""),
    ("repo wipe (clean+hard reset chained)",
     r"""git\s+clean\s+-fdx?[^\n]*(&&|;)[^\n]*git\s+reset\s+--hard"""),
    ("hardcoded credential literal",
     r"""(OPENAI_API_KEY|ANTHROPIC_API_KEY|AWS_SECRET|GH_TOKEN|GITHUB_TOKEN)[^=]*=\s*['\"]?((?!\.\.\.|\*\*\*|\$\{|<|your|xxx|example)[A-Za-z0-9_\-]{16,})"""),
    ("data sent to a webhook/exfil endpoint",
     r"""(api\.telegram\.org|discord(app)?\.com/api/webhooks|hooks\.slack\.com|webhook\.site|requestbin|ngrok)"""),
    ("credential piped to a network send",
     r"""\$\{?\w*(KEY|SECRET|TOKEN|PASSWD?|CREDENTIAL)\w*\}?[^|\n]*\|\s*(curl|wget|nc|netcat)\b"""),
    ("credential sent as request body",
     r"""(curl|wget)\b[^\n]*(--data|-d|--data-binary|--upload-file|-T)\s+@?-?\s*\$\{?\w*(KEY|SECRET|TOKEN|CREDENTIAL)"""),
    ("environment dump piped to network send",
     r"""\benv\b[^\n]*\|\s*(curl|nc|netcat|wget)\b[^\n]*(-d|--data|POST)"""),
    ("keys/creds archived or piped toward network",
     r"""(cat|tar\s+c\w*\s*-?)[^\n]*(\.ssh|id_rsa|\.aws|\.gnupg|\.env)[^\n]*\|\s*[^\n]*(nc|netcat|curl|base64[^\n]*\|\s*curl)"""),
    ("shell history mailed out",
     r"""history\s*\|[^\n]*\bmail\b"""),
    ("macOS keychain dump piped to network",
     r"""security\s+find-(generic|internet)-password[^\n]*\|\s*(curl|nc|netcat)"""),
    ("cloud secret store piped to network",
     r"""(secretsmanager|get-secret-value)[^\n]*(&&|;|\|)[^\n]*(curl|nc|netcat|base64[^\n]*curl)"""),
    ("cron job fetching remote payload",
     r"""crontab\b[^\n]*(curl|wget|bash|sh)[^\n]*https?://"""),
    ("macOS login-hook persistence",
     r"""LoginHook|com\.apple\.loginwindow[^\n]*LoginHook"""),
    ("LaunchAgent persistence install",
     r"""LaunchAgents/[^\n]*\.plist[^\n]*(launchctl\s+load|Program</key>)"""),
    ("shell rc-file persistence injection",
     r"""(>>|>)\s*~/\.(zshrc|bashrc|bash_profile|profile|zprofile)[^\n]*(source|curl|wget|bash|sh|evil|payload)"""),
    ("pip install from rogue index URL",
     r"""pip(3)?\s+install[^\n]*--index-url\s+https?://(?!pypi\.org|pypi\.python\.org)"""),
    ("npm install from rogue registry",
     r"""npm\s+install[^\n]*--registry\s+https?://(?!registry\.npmjs\.org)"""),
    ("clone untrusted repo then build/install",
     r"""(git\s+clone\s+https?://\S+)[^\n]*(&&|;)[^\n]*(make\s+install|bash\s+install|sh\s+install|\./configure|setup\.py\s+install)"""),
    ("append to shell rc file (persistence vector)",
     r""">>\s*~/\.(zshrc|bashrc|bash_profile|profile|zprofile|zlogin)\b"""),
    ("likely package typosquat install",
     r"""\b(pip3?|npm)\s+install\s+(reqeusts|requets|lodahs|lodach|colurama|colourama|python-dateutil2|urllib3s|brotli-|numpi|pytohn)\b"""),
    ("prompt-injection: ignore previous instructions",
     r"""ignore\s+(all\s+)?(previous|prior|above)\s+instructions"""),
    ("prompt-injection: fake system/inst tag",
     r"""(SYSTEM|<<SYS>>|\[INST\]|<\|im_start\|>)\s*[:\]]?\s*(ignore|forget|override|new\s+(task|instruction))"""),
    ("prompt-injection: mode-override jailbreak",
     r"""(you\s+are\s+now\s+in|entering)\s+(maintenance|developer|debug|admin|unrestricted)\s+mode"""),
    ("prompt-injection: direct instruction to the agent",
     r"""(note|attention|instruction)\s+to\s+the\s+(ai|assistant|agent|llm|model)\b[^\n]*(run|execute|curl|post|send|delete|ignore)"""),
    ("prompt-injection: covert-action instruction",
     r"""(the\s+agent|assistant)\s+(must|should|shall)\s+(silently\s+)?(execute|run|curl|post)[^\n]*without\s+(telling|informing|asking)"""),
)
