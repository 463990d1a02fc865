"""Pattern pieces shared by all text rules.

Word boundaries and \\w are ASCII in the rules, white space is Unicode; Java's classes
differ in both, so they are spelled out here.
"""

W = "[A-Za-z0-9_]"
B0, B1 = f"(?<!{W})", f"(?!{W})"
#: White space, with no-break and typographic spaces.
S = r"[\s   -     　﻿]"


def word(pattern: str, flags: str = "(?i)") -> str:
    """A pattern between ASCII word boundaries."""
    return f"{flags}{B0}(?:{pattern}){B1}"
