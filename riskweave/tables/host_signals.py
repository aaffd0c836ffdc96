"""Host scoring values and the seed blocklist."""

# Host suffixes, top-level domains, tokens, seed hosts and digest.

FREE_SUBDOMAIN_SUFFIXES = (
    "ct.ws", "000webhostapp.com", "rf.gd", "byethost.com", "000webhost.com",
    "infinityfreeapp.com", "eu.org", "duckdns.org", "no-ip.com", "ddns.net",
)

SUSPECT_TLDS = (
    ".xyz", ".top", ".icu", ".click", ".link", ".live", ".buzz",
    ".online", ".site", ".club", ".loan", ".win", ".cam",
)

LOOKALIKE_TOKENS = (
    "spotify", "login", "verify", "secure", "account", "vote",
    "wallet", "airdrop", "support", "auth", "signin", "update",
)

SEED_HOSTS = (
    "ceditex.ct.ws",
    "podcastambassadorsprimes.ct.ws",
    "sizipod.ct.ws",
    "votce-new.ct.ws",
    "xedipod.ct.ws",
    "zezi-pod.ct.ws",
    "zezipod.ct.ws",
)
SEED_SHA256 = "51942ab92e2f59fc99bc50e3228bacb4f38096ee74f81e4fc63564f24fd39b0d"

URL_PATTERN = r"""(?:https?://|www\.)[^\s'"<>|)\]]+"""
HOST_PATTERN = r"""^(?:https?://)?(?:[^/@\s]*@)?([^/:?\s]+)"""
IP_LITERAL_PATTERN = r"""^\d{1,3}(?:\.\d{1,3}){3}$"""
PUNYCODE_PATTERN = r"""(^|\.)xn--"""
