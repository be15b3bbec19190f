"""Plain counterparts used by several tests."""

import re

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = ("assign", "access", "hex")


def plain_secrets(text):
    """Spans of the base kinds by whole-text scanning."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))
