"""Regular expressions and fixed values. Every pattern here reads the same in Java and in RE2 unless it says otherwise."""

# Markers that replace parts of a message. A marker ends in END; some carry a payload before it.
END = "ENDVAR"
NEWLINE = "ENTERNEWLINE"
SUBJECT = "MAILSUBJECT"
EMAIL = "EMAIL"
LINK = "LINK"
PHONE = "PHONENUMBER"
EMOJI = "EMOJI"

# White space as Unicode has it and the rest, both spelled out, since \s and \S are ASCII in Java and RE2. The class of
# other characters starts with the frequent ones, which Java tries first.
SPACE = r"[ \t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)  # the same as a string
_BEYOND_ASCII = (
    r"\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}"
    r"\x{3001}-\x{10ffff}\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f"
)
CHAR = f"[!-~{_BEYOND_ASCII}]"
WORD = CHAR + "+"
WHOLE_LETTER = r"(?![\x{dc00}-\x{dfff}])"  # Java steps by UTF-16 units: do not start inside a letter
FIELD = f"[!-}}{_BEYOND_ASCII}]+"  # a word without "~"
NOT_AT = f"[!-?A-~{_BEYOND_ASCII}]+"  # a word without "@"

# Letter classes (the inside of a bracket). Hebrew is the 22 letters and 5 finals.
SCRIPTS = {
    "hebrew": r"\x{5d0}-\x{5ea}",
    "latin": r"A-Za-zÀ-ÖØ-öø-ÿ",
    "accented": r"À-ÖØ-öø-ÿ",
}

# All but the letters of "latin", spelled out with the frequent ones first, which Java tests much faster than [^...].
BESIDE_LATIN = r" -@\[-`{-\x{bf}\x{d7}\x{f7}\x{100}-\x{10ffff}\x00-\x1f"

# ASCII signs 33-47, 58-64, 91-96, 123-126, and the punctuation that is counted.
SIGNS = r"!-/:-@\[-`{-~"
PUNCTUATION = r""",.:!?'"\-"""

# Direction marks that messengers put into exported lines.
DIRECTION_MARKS = r"[\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]"

# Chat export: "[d.m.yyyy, h:m:s] name: ". Groups: day, month, year, hour, minute, second, name.
CHAT_HEADER = (
    r"^\[([0-9]+)[^0-9]([0-9]+)[^0-9]([0-9]{4})[^0-9] ([0-9]+):([0-9]+):([0-9]+)\] (.*?): "
)

# Service phrases of the messenger, without direction marks.
SYSTEM_PHRASES = [
    "יצרת את קבוצת",
    "צר/ה את קבוצת",
    "צירף/ה אותך",
    "כעת ההודעות הנשלחות בקבוצה זו מאובטחות עם הצפנה מקצה",
    "מחקת הודעה זו.",
    "הודעה זו נמחקה",
    "צירף/ה את",
    "הינך מנהל/ת קבוצה",
    "צירפת את",
    "החליף/ה את תמונת",
    "עזב/ה.",
    "קוד האבטחה של",
    "הנושא שונה ל",
    "הסיר/ה את",
    "החלפת את הנושא אל",
]

# The two separator rows of hand-cleaned files.
DASH_ROW = "-" * 84
PLUS_ROW = "+" * 19

# What makes a word a link.
LINK_SCHEMES = ["http:", "https:"]
LINK_HOSTS = ["www.", "goo.gl", "bit.ly", "youtu.be", "nl.me", "vp4.me", "hyperurl.co", "wa.me", ".net"]
LINK_ENDINGS = [".co.il", ".com"]


def any_of(words: list[str]) -> str:
    """Alternation of literal words."""
    return "(?:" + "|".join("".join("\\" + c if c in r"\.+*?()[]{}|^$" else c for c in w) for w in words) + ")"


LINK_PARTS = LINK_SCHEMES + LINK_HOSTS + LINK_ENDINGS
LINK_HINT = any_of(LINK_PARTS)
LINK_FROM_SCHEME = "https?:.*$"

# Fixed value: e-mail address inside a word.
EMAIL_ADDRESS = rf"{NOT_AT}@{NOT_AT}\.[a-zA-z]+"

# Phone shapes. Order does not matter, the class comes from the digit count.
PHONE_SHAPES = [
    "1[1-9]00-?[0-9]{3}-?[0-9]{3}",
    "0[2-9]-?[0-9]{7}",
    "0[2-9][0-9]-?[0-9]{7}",
    r"\*[0-9]{4}",
    r"[0-9]{4}\*",
    "[+|@]972[0-9]{9}",
]
PHONE_SHAPE = "(?:" + "|".join(PHONE_SHAPES) + ")"
PHONE_DIGITS = [4, 9, 10, 12]
PHONE_EDGE = "[0-9|*+@]"

# Code points with the Unicode property Emoji, without the ASCII ones.
EMOJI_GLYPHS = (
    r"\x{a9}\x{ae}\x{203c}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21a9}\x{21aa}\x{231a}\x{231b}\x{2328}\x{23cf}"
    r"\x{23e9}-\x{23f3}\x{23f8}-\x{23fa}\x{24c2}\x{25aa}\x{25ab}\x{25b6}\x{25c0}\x{25fb}-\x{25fe}\x{2600}-\x{2604}"
    r"\x{260e}\x{2611}\x{2614}\x{2615}\x{2618}\x{261d}\x{2620}\x{2622}\x{2623}\x{2626}\x{262a}\x{262e}\x{262f}"
    r"\x{2638}-\x{263a}\x{2640}\x{2642}\x{2648}-\x{2653}\x{265f}\x{2660}\x{2663}\x{2665}\x{2666}\x{2668}\x{267b}"
    r"\x{267e}\x{267f}\x{2692}-\x{2697}\x{2699}\x{269b}\x{269c}\x{26a0}\x{26a1}\x{26a7}\x{26aa}\x{26ab}\x{26b0}"
    r"\x{26b1}\x{26bd}\x{26be}\x{26c4}\x{26c5}\x{26c8}\x{26ce}\x{26cf}\x{26d1}\x{26d3}\x{26d4}\x{26e9}\x{26ea}"
    r"\x{26f0}-\x{26f5}\x{26f7}-\x{26fa}\x{26fd}\x{2702}\x{2705}\x{2708}-\x{270d}\x{270f}\x{2712}\x{2714}\x{2716}"
    r"\x{271d}\x{2721}\x{2728}\x{2733}\x{2734}\x{2744}\x{2747}\x{274c}\x{274e}\x{2753}-\x{2755}\x{2757}\x{2763}"
    r"\x{2764}\x{2795}-\x{2797}\x{27a1}\x{27b0}\x{27bf}\x{2934}\x{2935}\x{2b05}-\x{2b07}\x{2b1b}\x{2b1c}\x{2b50}"
    r"\x{2b55}\x{3030}\x{303d}\x{3297}\x{3299}\x{1f004}\x{1f0cf}\x{1f170}\x{1f171}\x{1f17e}\x{1f17f}\x{1f18e}"
    r"\x{1f191}-\x{1f19a}\x{1f1e6}-\x{1f1ff}\x{1f201}\x{1f202}\x{1f21a}\x{1f22f}\x{1f232}-\x{1f23a}\x{1f250}"
    r"\x{1f251}\x{1f300}-\x{1f64f}\x{1f680}-\x{1f6ff}\x{1f7e0}-\x{1f7eb}\x{1f90c}-\x{1f9ff}\x{1fa70}-\x{1faff}"
)
BEYOND_LATIN = r"[\x{a9}\x{ae}\x{203c}-\x{10ffff}]"  # holds every glyph above
SYMBOL_GLYPHS = r"#$%&*|"  # stands in for emoji where a table has none

# A marker as a whole word; groups: kind, payload. RE2 and Java.
MARKER = rf"^(?:({NEWLINE}|{SUBJECT}|{EMAIL}|{LINK}|{PHONE}|{EMOJI})([0-9]+|@|[^A-Za-z0-9])?){END}"
