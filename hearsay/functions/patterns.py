"""Regex text shared by every cleaner.

Python's ``\\w``, ``\\d`` and ``\\s`` cover all of Unicode while Java's are ASCII, so the classes are
spelled out. They use as few ranges and properties as possible, because a backtracking engine
tests them one after the other at every character.
"""

# Character classes and removal patterns.
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
WORD = r"\w\p{L}\p{N}"
MENTION = f"@[{WORD}]+"
HASHTAG = f"#[{WORD}]+"
URL = r"https?://[a-zA-Z0-9$-_@.&+!*\\(),]+"
NUMBER = r"\p{Nd}+"
PUNCTUATION = f"[^{WORD}{SPACE}]"
STRICT_EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{2702}-\x{27B0}\x{24C2}]+"
)
# The default emoji ranges; the last one holds three smaller ranges and most of CJK.
EMOJI = r"[\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{24C2}-\x{1F251}]+"
SPACES = f"[{SPACE}]+"
NON_SPACE = f"[^{SPACE}]"

# Non-space text around an at sign. A match always covers a whole unbroken run, so it starts only
# where a run starts, and the part before the sign never gives characters back: time stays linear
# in the length of a run.
EMAIL = f"(?<!{NON_SPACE}){NON_SPACE}[^{SPACE}@]*+@{NON_SPACE}+"

# Words without the punctuation beside them, as word lists and word counts see them.
WORD_RUN = f"[{WORD}]+"

# Vectoriser tokens: unbroken runs of two or more word characters.
TOKEN = f"[{WORD}]{{2,}}"
SPECIAL = rf"[^\p{{L}}\p{{N}}{SPACE}]"
UPPER = r"\p{IsUppercase}"
TAG_WORD = f"#([{WORD}]+)"

# Capitalised words in a row. Possessive, so that a long run does not recurse once per word.
NAME_RUN = r"\p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)*+"

# Digits by Unicode's numeric type "digit": decimal digits plus super- and subscript, circled,
# parenthesised and similar forms.
DIGIT = (
    r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}"
    r"\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}]"
)

# The whitespace class once more as plain characters, for trimming.
SPACE_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
