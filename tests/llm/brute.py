"""Plain re-statements that several tests compare with."""

import re


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
