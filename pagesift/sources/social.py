"""The template and the queries for links to social networks."""

from __future__ import annotations

from pagesift.sources.templates import Template, entries_of

# Patterns, texts in front and behind, and settings decide the results.
SOCIAL_TEMPLATE = {
    "telegram": {
        "extract": r't\.me\/(?:(?!(?:share)(?:(?:\/|\?|\\|"|\<)*$|(?:\/|\?|\\|\"|\<)[\s\S]))[\w\d\.\_\-\+\@]+)(?<!\.)',
        "extract_prepend": "https://",
        "validate": '<meta property="og:title" content="Telegram: Contact .+?">',
    },
    "discord": {
        "extract": r"discord\.(?:com|gg)\/invite\/[\w\d\.\_\-\+\@]+(?<!\.)",
        "extract_prepend": "https://",
        "validate": "Invite Invalid",
        "validate_browser": True,
        "validate_browser_wait": 6,
    },
    "youtube": {
        "extract": r"youtube\.com\/(?:c|channel)\/[\w\d\.\_\-\+\@]+(?<!\.)",
        "extract_prepend": "https://www.",
        "validate": r'<iframe.+?src="\/error\?src=404.+?">',
        "validate_cookies": {"SOCS": "CAESEwgDEgk2OTk3ODk2MzcaAmVuIAEaBgiAn5S6Bg"},
    },
    "twitter": {
        "extract": r'(?<=(?<!pic\.)twitter|(?<!pic\.)x)\.com\/(?:(?!(?:[\w]{2}\/)*(?:explore|hashtag|home|i|intent|library|media|personalization|privacy|search|share|tos|widgets\.js)(?:(?:\/|\?|\\|"|\<)*$|(?:\/|\?|\\|\"|\<)[\s\S]))[\w\d\.\_\-\+\@]+)(?<!\.)',
        "extract_prepend": "https://x",
        "validate": "This account doesn.?t exist",
        "validate_browser": True,
        "validate_cookies": {"night_mode": "2"},
    },
    "facebook": {
        "extract": r'facebook\.com\/(?:(?!(?:about|dialog|gaming|groups|public|sharer|share\.php|terms\.php)(?:(?:\/|\?|\\|"|\<)*$|(?:\/|\?|\\|\"|\<)[\s\S]))[\w\d\.\_\-\+\@]+)(?<!\.)',
        "extract_prepend": "https://www.",
        "validate": "This (?:content|page) isn't available",
        "validate_browser": True,
    },
    "instagram": {
        "extract": r'instagram\.com\/(?:(?!(?:about|accounts|ar|explore|p)(?:(?:\/|\?|\\|"|\<)*$|(?:\/|\?|\\|\"|\<)[\s\S]))[\w\d\.\_\-\+\@]+)(?<!\.)',
        "extract_prepend": "https://www.",
        "extract_append": "/",
        "validate": r"Sorry, this page isn't available\.",
        "validate_browser": True,
    },
    "tiktok": {
        "extract": r"(?<!vt\.)tiktok\.com\/\@[\w\d\.\_\-\+\@]+(?<!\.)",
        "extract_prepend": "https://www.",
        "validate": "Couldn't find this account",
    },
    "linkedin-company": {
        "extract": r"linkedin\.com\/company\/[\w\d\.\_\-\+\@\&]+(?<!\.)",
        "extract_prepend": "https://www.",
        "validate": "Page not found",
        "validate_cookies": {"bcookie": "v=2", "lang": "v=2&lang=en-us"},
    },
    "linkedin-user": {
        "extract": r"linkedin\.com\/in\/[\w\d\.\_\-\+\@\&]+(?<!\.)",
        "extract_prepend": "https://www.",
        "validate": r"An exact match for .+ could not be found\.",
    },
}

# One query per network.
SOCIAL_QUERIES = (
    'intext:"t.me/"',
    'intext:"discord.com/invite/" OR intext:"discord.gg/invite/"',
    'intext:"youtube.com/c/" OR intext:"youtube.com/channel/"',
    'intext:"twitter.com/" OR intext:"x.com/"',
    'intext:"facebook.com/"',
    'intext:"instagram.com/"',
    'intext:"tiktok.com/"',
    'intext:"linkedin.com/in/" OR intext:"linkedin.com/company/"',
)


def social_template() -> Template:
    return entries_of(SOCIAL_TEMPLATE)
