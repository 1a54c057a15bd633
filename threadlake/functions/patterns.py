"""Patterns, word lists, constants and lookup tables.

Every value below has to equal what chat exports contain and what the archive
format prescribes, so they are stated plainly and kept together.  Regular
expressions use Java syntax because Spark evaluates them in the JVM: ``(?iu)``
is Unicode-aware case folding, ``(?d)`` makes ``\\n`` the only line terminator,
and the whitespace classes are spelled out so that they hold the same
characters in every engine.
"""

from __future__ import annotations

import unicodedata

# --- character classes (derived by rule from the Unicode database) -----------

#: Every whitespace character of the basic plane, as a trim set.
WHITESPACE = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())


def _escaped(chars: str) -> str:
    """The characters as the body of a regex class, runs written as ranges."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(
        f"\\u{a:04x}" if a == b else f"\\u{a:04x}-\\u{b:04x}" for a, b in runs
    )


#: Regex class bodies: any whitespace, and whitespace that stays on one line.
WS = _escaped(WHITESPACE)
WS_INLINE = _escaped(WHITESPACE.replace("\n", "").replace("\r", ""))
#: The same characters as one property test, which is much faster than the ranges.
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

#: Decimal digits of every script in the basic plane and their ASCII values.
DIGITS = "".join(
    chr(c) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Nd"
)
DIGITS_ASCII = "".join(str(unicodedata.digit(c)) for c in DIGITS)

#: End of word, for hints that must not continue into a longer word.
WORD_END = r"(?![\p{L}\p{N}_])"

# --- invisible characters ---------------------------------------------------------

DIRECTION_MARKS = r"\u200e\u200f"
MARKS = r"[\u200b-\u200f\u2066-\u2069\ufeff]"
INVISIBLE = r"[\u200b-\u200f\u2066-\u2069\ufeff\u00ad]"
COMBINING_MARKS = r"[\u0300-\u036f]"

# --- message and attachment kinds -----------------------------------------------------

MESSAGE_KINDS = ("text", "system", "media", "deleted", "call", "location", "poll", "contact")
KIND_CODES = {
    "text": "t",
    "system": "y",
    "media": "m",
    "deleted": "d",
    "call": "c",
    "location": "l",
    "poll": "p",
    "contact": "v",
}
ATTACHMENT_KINDS = (
    "image", "video", "audio", "voice", "sticker", "gif", "document", "contact", "missing",
)
VIEWABLE_KINDS = ("image", "video", "gif", "sticker")
PREVIEW_LABELS = {
    "voice": "Voice message",
    "image": "Photo",
    "video": "Video",
    "sticker": "Sticker",
    "gif": "GIF",
    "missing": "Media",
}

#: extension -> (attachment kind, mime type); anything else is a document.
MEDIA_TYPES = {
    "jpg": ("image", "image/jpeg"),
    "jpeg": ("image", "image/jpeg"),
    "png": ("image", "image/png"),
    "gif": ("gif", "image/gif"),
    "webp": ("sticker", "image/webp"),
    "heic": ("image", "image/heic"),
    "bmp": ("image", "image/bmp"),
    "mp4": ("video", "video/mp4"),
    "mov": ("video", "video/quicktime"),
    "3gp": ("video", "video/3gpp"),
    "webm": ("video", "video/webm"),
    "avi": ("video", "video/x-msvideo"),
    "opus": ("voice", "audio/ogg"),
    "ogg": ("voice", "audio/ogg"),
    "m4a": ("audio", "audio/mp4"),
    "aac": ("audio", "audio/aac"),
    "mp3": ("audio", "audio/mpeg"),
    "wav": ("audio", "audio/wav"),
    "amr": ("audio", "audio/amr"),
    "vcf": ("contact", "text/vcard"),
    "pdf": ("document", "application/pdf"),
}
DEFAULT_MEDIA_TYPE = ("document", "application/octet-stream")
VOICE_NAME = r"(?iu)(?:^|[-_])(?:PTT|AUDIO)[-_]"

# --- transcript headers ------------------------------------------------------------

#: Date, time and meridiem in that order: seven groups.
STAMP = (
    r"(\p{Nd}{1,4})[./\-](\p{Nd}{1,2})[./\-](\p{Nd}{2,4})"
    rf"[,{WS_INLINE}]+"
    r"(\p{Nd}{1,2}):(\p{Nd}{2})(?::(\p{Nd}{2}))?"
    rf"(?:[{WS_INLINE}]*([APap]\.?[Mm]\.?|ص\.?|م\.?))?"
)
#: "[stamp] rest" and "stamp - rest".
BRACKET_HEADER = (
    rf"\[(?=[^\]\n]{{6,44}}\])[{WS_INLINE}]*{STAMP}[{WS_INLINE}]*\][ \u202f\u00a0]*"
)
DASH_HEADER = rf"(?=\p{{Nd}}[^\n]{{5,42}}? - ){STAMP}[{WS_INLINE}]*? - "
HEADER = rf"[{DIRECTION_MARKS}]*(?:{BRACKET_HEADER}|{DASH_HEADER})"
MORNING = ("A", "a", "ص")
EVENING = ("P", "p", "م")
MAX_SENDER_LENGTH = 72

# --- message bodies ----------------------------------------------------------------

ATTACHED = (
    rf"(?d)^[{DIRECTION_MARKS}]*<[^<>:]{{1,24}}:[{WS}]*([^<>]+?)[{WS}]*>[{DIRECTION_MARKS}]*$"
)
FILE_ATTACHED = (
    rf"(?diu)^[{DIRECTION_MARKS}]*([^{WS}<>][^\n]*?\.[A-Za-z0-9]{{2,5}})[{WS}]*"
    r"\([^()]{0,24}(?:attach|anexad|adjunt|allegat|angeh|bijgevoeg|bifoga|"
    r"liitte|załącz|прикреп|مرفق|添付)[^()]{0,24}\)"
    rf"[{WS}]*$"
)
OMITTED = (
    rf"(?diu)^[{DIRECTION_MARKS}]*(?:<[{WS}]*)?"
    r"(?:media|image|photo|video|audio|sticker|gif|document|contact card|imagem|"
    r"v[ií]deo|[áa]udio|figurinha|documento|imagen|foto|adjunto|multimedia)"
    r"[^\n]{0,24}?"
    r"(?:omitted|omitida|omitido|ausente|weggelassen|omis)"
    rf"(?:[{WS}]*>)?[{DIRECTION_MARKS}]*[{WS}]*$"
)
DELETED = (
    rf"(?diu)^[{DIRECTION_MARKS}]*(?:this message was deleted|you deleted this message|"
    r"esta mensagem foi apagada|voc[eê] apagou esta mensagem|"
    rf"se elimin[oó] este mensaje|eliminaste este mensaje)\.?[{WS}]*$"
)
EDITED = (
    rf"(?diu)[{DIRECTION_MARKS}]*<[{WS}]*(?:this message was edited|"
    rf"esta mensagem foi editada|se edit[oó] este mensaje)[{WS}]*>[{WS}]*$"
)
CALL = (
    rf"(?iu)^[{DIRECTION_MARKS}]*(?:missed (?:voice|video|group) call|"
    r"chamada de (?:voz|v[ií]deo) perdida|llamada (?:de voz|de v[ií]deo) perdida|"
    rf"voice call|video call){WORD_END}"
)
LOCATION = r"(?iu)(?:maps\.google\.com/\?q=|google\.com/maps)"
POLL = rf"(?iu)^[{DIRECTION_MARKS}]*POLL:"

# --- notices -----------------------------------------------------------------------

SYSTEM_HINTS = (
    r"(?iu)(?:end-to-end encrypted|created (?:this )?group|added you|changed the subject|"
    rf"changed this group's icon|changed their phone number|joined using|left{WORD_END}|"
    rf"removed{WORD_END}|became an admin|security code changed|are end-to-end encrypted|"
    rf"criptografad[ao]|criou o grupo|adicionou|saiu{WORD_END}|removeu|mudou o assunto|"
    r"cifrad[ao]s de extremo a extremo|cre[óo] el grupo|a[ñn]adi[óo]|sali[óo])"
)
GROUP_HINTS = (
    rf"(?iu)(?:created (?:this )?group|added{WORD_END}|left{WORD_END}|removed{WORD_END}|"
    r"became an admin|changed the subject|group description|criou o grupo|adicionou|"
    r"saiu do grupo|removeu|cre[óo] el grupo|a[ñn]adi[óo])"
)

# --- titles ------------------------------------------------------------------------

TITLE_PREFIX = (
    rf"(?iu)^(?:whatsapp[{WS}]+chat[{WS}]+(?:with|-)[{WS}]*"
    rf"|conversa[{WS}]+do[{WS}]+whatsapp[{WS}]+com[{WS}]*"
    rf"|chat[{WS}]+de[{WS}]+whatsapp[{WS}]+con[{WS}]*"
    rf"|whatsapp[{WS}_-]*chat[{WS}_-]*)"
)
TITLE_COUNTER = rf"[{WS}]*\(\p{{Nd}}+\)$"
TITLE_DATE = rf"[{WS}_-]+\p{{Nd}}{{4}}-\p{{Nd}}{{2}}-\p{{Nd}}{{2}}$"
UNKNOWN_TITLE = "Unknown chat"
PLACEHOLDER_TITLE = (
    r"(?diu)^(?:_chat|unknown chat|group \(\p{Nd}+ participants\)|.+ / .+)$"
)

# --- attachment names ------------------------------------------------------------------

SEQUENCE_PREFIX = r"^\p{Nd}{6,10}-"
UNSAFE_NAME = r"[^A-Za-z0-9._-]+"

# --- limits and thresholds --------------------------------------------------------------

OVERLAP_THRESHOLD = 0.15
CLOSE_TITLE_RATIO = 0.92
OWNER_NAME_RATIO = 0.75
SNIPPET_BEFORE = 34
SNIPPET_AFTER = 90
PREVIEW_LENGTH = 120
PAGE_SIZE = 250
RUN_GAP_SECONDS = 900
HEADER_NAMES = 6
JUMBO_UNITS = 24

# --- links, inline markup, emoji ------------------------------------------------------------

#: Whitespace as the viewer counts it.
VIEW_WS = _escaped(WHITESPACE.translate({0x1C: None, 0x1D: None, 0x1E: None, 0x1F: None, 0x85: 0xFEFF}))
URL = rf"""((?:https?://|www\.)[^{VIEW_WS}<>"']+[^{VIEW_WS}<>"'.,;:!?)\]}}])"""
CODE_BLOCK = r"```\n?([\s\S]*?)```"
CODE_SPAN = r"`([^`\n]+)`"
INLINE_MARKS = ("*", "_", "~")
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
#: Pictographs, emoji components (digits, # and *, modifiers, flags, tags) and joiners.
EMOJI = (
    r"0-9#*\u00a9\u00ae\u200d\u203c\u2049\u20e3\u2122\u2139\u2194-\u2199\u21a9\u21aa"
    r"\u231a\u231b\u2328\u2388\u23cf\u23e9-\u23f3\u23f8-\u23fa\u24c2\u25aa\u25ab\u25b6\u25c0"
    r"\u25fb-\u25fe\u2600-\u2605\u2607-\u2612\u2614-\u2685\u2690-\u2705\u2708-\u2712\u2714"
    r"\u2716\u271d\u2721\u2728\u2733\u2734\u2744\u2747\u274c\u274e\u2753-\u2755\u2757"
    r"\u2763-\u2767\u2795-\u2797\u27a1\u27b0\u27bf\u2934\u2935\u2b05-\u2b07\u2b1b\u2b1c"
    r"\u2b50\u2b55\u3030\u303d\u3297\u3299\ufe0f"
    r"\x{1f000}-\x{1f0ff}\x{1f10d}-\x{1f10f}\x{1f12f}\x{1f16c}-\x{1f171}\x{1f17e}\x{1f17f}"
    r"\x{1f18e}\x{1f191}-\x{1f19a}\x{1f1ad}-\x{1f1ff}\x{1f201}-\x{1f20f}\x{1f21a}\x{1f22f}"
    r"\x{1f232}-\x{1f23a}\x{1f23c}-\x{1f23f}\x{1f249}-\x{1f53d}\x{1f546}-\x{1f64f}"
    r"\x{1f680}-\x{1f6ff}\x{1f774}-\x{1f77f}\x{1f7d5}-\x{1f7ff}\x{1f80c}-\x{1f80f}"
    r"\x{1f848}-\x{1f84f}\x{1f85a}-\x{1f85f}\x{1f888}-\x{1f88f}\x{1f8ae}-\x{1f8ff}"
    r"\x{1f90c}-\x{1f93a}\x{1f93c}-\x{1f945}\x{1f947}-\x{1faff}\x{1fc00}-\x{1fffd}"
    r"\x{e0020}-\x{e007f}"
)
EMOJI_ONLY = rf"^[{EMOJI}{VIEW_WS}]+$"
