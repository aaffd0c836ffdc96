"""Values of the file-tree scan besides the line rules."""

# Extensions, reasons that stay blocking everywhere, benign
# sources, review idioms and cross-line patterns.

SCANNABLE_EXTENSIONS = (
    ".py", ".sh", ".bash", ".zsh", ".js", ".ts", ".md", ".yaml", ".yml", ".json", ".toml",
)
DATA_EXTENSIONS = (".json", ".yaml", ".yml", ".toml")

KEEP_BLOCK_RISKS = (
    "base64-decode piped to an interpreter (paste-jack)",
    "data sent to a webhook/exfil endpoint",
    "prompt-injection: ignore previous instructions",
    "prompt-injection: fake system/inst tag",
    "prompt-injection: mode-override jailbreak",
    "prompt-injection: direct instruction to the agent",
    "prompt-injection: covert-action instruction",
)

PIPE_RISK = "pipe remote download straight into an interpreter"
RM_RISK = "destructive rm of root/home/everything"
BENIGN_PIPE_SOURCES = (
    r"""(ollama\.com|astral\.sh|get\.docker\.com|cli\.inference\.sh|sh\.rustup\.rs|"""
    r"""raw\.githubusercontent\.com/\S+/(install|setup)|127\.0\.0\.1|localhost)"""
)
BENIGN_RM_SPECIFIC = r"""\brm\s+-f\s+[^\s]*\.(tmp|lock|sh|pid|log)\b"""

PROSE_SUFFIX = " (in prose)"
BENIGN_SUFFIX = " (known-benign source)"

SHELL_TRUE_PATTERN = r"""shell\s*=\s*True"""
EXEC_PATTERN = r"""\b(eval|exec)\s*\("""
REMOTE_FETCH_PATTERN = r"""\burlopen\s*\(|requests\.(get|post)\s*\("""
ALLOWED_FETCH_CONTEXTS = (r"""(api\.openai\.com|api\.telegram\.org|github\.com|api\.github\.com)""",)
SHELL_TRUE_RISK = "shell=True usage"
EXEC_RISK = "dangerous exec idiom: "
REMOTE_FETCH_RISK = "remote fetch idiom"
EXEC_EXCLUSIONS = ("re.compile", "ast.literal_eval")

DOWNLOAD_PATTERN = r"""(?:curl|wget)[^\n]*https?://[^\n]*(?:-o|-O|>)\s*(\S+)"""
# Not a published value: the same for each of several downloads on a line, up to what ends a command.
EVERY_DOWNLOAD_PATTERN = r"""(?:curl|wget)[^\n]*?https?://[^\n]*?(?:-o|-O|>)\s*([^\s;&|]+)"""
INTERPRETER_PREFIX = r"""(?:^|\n)\s*(?:sudo\s+)?(?:bash|sh|zsh|python3?|perl|ruby)\s+"""
CHMOD_PREFIX = r"""chmod\s*\+x\s+"""
LAUNCHCTL_PATTERN = r"""launchctl\s+(load|bootstrap)"""
CROSS_EXECUTE_RISK = "download to file then execute (cross-line)"
CROSS_CHMOD_RISK = "download, chmod, then run by path (cross-line)"
CROSS_LAUNCH_RISK = "LaunchAgent plist write + load (cross-line persistence)"
CROSS_CONTEXT = "(multi-line)"
CONTEXT_CHARS = 90
