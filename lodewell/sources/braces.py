"""Symbols, calls and imports of languages that mark blocks by braces, by patterns over text without comments and strings.

No grammar is at hand for these languages, so this is a reading by patterns: definitions are found
by their keywords, their ends by the matching brace, owners by the innermost span. What macros or
preprocessors make is not seen.
"""

from __future__ import annotations

import re

_WORD = r"[A-Za-z_$][\w$]*"
_FUNCTION_C = rf"(?m)^[ \t]*(?!(?:return|else|new|throw|if|for|while|switch|case|using|typedef|delete|goto|public|private|protected)\b[ \t(:])(?:[\w:<>,*&~\[\] \t]+?[ \t*&])(?P<name>~?{_WORD}(?:::~?{_WORD})*)[ \t]*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)[ \t\w:&,()<>]*(?=\{{)"
_METHOD_JAVA = rf"(?m)^[ \t]*(?:@\w+(?:\([^)]*\))?[ \t]*)*(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|synchronized|native|default|partial|extern|unsafe|readonly)[ \t]+)*(?!(?:return|else|new|throw|if|for|while|switch|case|using)\b)(?:[\w.<>,?\[\] ]+?[ \t])?(?P<name>{_WORD})[ \t]*(?:<[^>()]*>)?\([^;{{}}]*?\)[^;{{}}()]*(?=\{{)"
#: For each language what defines a symbol, as (kind, pattern), and what imports a module.
DEFINITIONS = {
    "javascript": [
        ("class", rf"\bclass\s+(?P<name>{_WORD})"),
        ("function", rf"\bfunction\s*\*?\s*(?P<name>{_WORD})"),
        ("const-export", rf"\bexport\s+(?:const|let|var)\s+(?P<name>{_WORD})"),
        ("function", rf"(?m)^[ \t]*(?:const|let|var)\s+(?P<name>{_WORD})\s*=\s*(?:async\s*)?(?:\([^()]*\)|{_WORD})\s*=>"),
        ("method", rf"(?m)^[ \t]+(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*(?!(?:if|for|while|switch|catch|function|return|with)\b)(?P<name>{_WORD})\s*(?:<[^>()]*>)?\([^;{{}}]*?\)[^;{{}}()=]*(?=\{{)"),
    ],
    "go": [("function", rf"(?m)^func\s+(?P<name>{_WORD})\s*[\[(]"), ("method", rf"(?m)^func\s+\([^)]*\)\s*(?P<name>{_WORD})\s*\("), ("struct", rf"(?m)^type\s+(?P<name>{_WORD})(?:\[[^\]]*\])?\s+struct\b"), ("interface", rf"(?m)^type\s+(?P<name>{_WORD})(?:\[[^\]]*\])?\s+interface\b"), ("type", rf"(?m)^type\s+(?P<name>{_WORD})\s+(?!struct\b|interface\b)[\w\[*]")],
    "rust": [("function", rf"\bfn\s+(?P<name>{_WORD})"), ("struct", rf"\bstruct\s+(?P<name>{_WORD})"), ("enum", rf"\benum\s+(?P<name>{_WORD})"), ("trait", rf"\btrait\s+(?P<name>{_WORD})"), ("impl", rf"(?m)^[ \t]*(?:unsafe\s+)?impl(?:<[^{{]*?>)?\s+(?:[\w:<>, ']+\s+for\s+)?(?P<name>{_WORD})"), ("type", rf"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>{_WORD})")],
    "java": [("class", rf"\bclass\s+(?P<name>{_WORD})"), ("interface", rf"\binterface\s+(?P<name>{_WORD})"), ("enum", rf"\benum\s+(?P<name>{_WORD})"), ("method", _METHOD_JAVA)],
    "csharp": [("class", rf"\b(?:class|record)\s+(?P<name>{_WORD})"), ("interface", rf"\binterface\s+(?P<name>{_WORD})"), ("struct", rf"\bstruct\s+(?P<name>{_WORD})"), ("enum", rf"\benum\s+(?P<name>{_WORD})"), ("method", _METHOD_JAVA)],
    "kotlin": [("class", rf"\b(?:class|object)\s+(?P<name>{_WORD})"), ("interface", rf"\binterface\s+(?P<name>{_WORD})"), ("function", rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<name>{_WORD})")],
    "swift": [("class", rf"\b(?:class|actor)\s+(?!func\b|var\b)(?P<name>{_WORD})"), ("struct", rf"\bstruct\s+(?P<name>{_WORD})"), ("enum", rf"\benum\s+(?P<name>{_WORD})"), ("interface", rf"\bprotocol\s+(?P<name>{_WORD})"), ("function", rf"\bfunc\s+(?P<name>{_WORD})")],
    "php": [("class", rf"\bclass\s+(?P<name>{_WORD})"), ("interface", rf"\binterface\s+(?P<name>{_WORD})"), ("trait", rf"\btrait\s+(?P<name>{_WORD})"), ("function", rf"\bfunction\s+&?(?P<name>{_WORD})")],
    "c": [("struct", rf"\bstruct\s+(?P<name>{_WORD})\s*(?=\{{)"), ("enum", rf"\benum\s+(?P<name>{_WORD})\s*(?=\{{)"), ("function", _FUNCTION_C)],
    "cpp": [("class", rf"\bclass\s+(?P<name>{_WORD})(?=[^;(){{}}]*\{{)"), ("struct", rf"\bstruct\s+(?P<name>{_WORD})(?=[^;(){{}}]*\{{)"), ("enum", rf"\benum\s+(?:class\s+)?(?P<name>{_WORD})"), ("function", _FUNCTION_C)],
}
DEFINITIONS["typescript"] = [*DEFINITIONS["javascript"], ("interface", rf"\binterface\s+(?P<name>{_WORD})"), ("type", rf"(?m)^[ \t]*(?:export\s+)?type\s+(?P<name>{_WORD})[^=\n]*="), ("enum", rf"\benum\s+(?P<name>{_WORD})")]
IMPORTS = {
    "javascript": r"(?m)^[ \t]*(?:import|export)\b[^'\"\n;]*?(?:from\s*)?['\"]([^'\"]+)['\"]|\brequire\(\s*['\"]([^'\"]+)['\"]",
    "go": r"(?m)^[ \t]*(?:import\s+)?(?:[\w.]+[ \t]+)?\"([\w./-]+)\"[ \t]*$",
    "rust": r"(?m)^[ \t]*(?:pub\s+)?use\s+([\w:]+)",
    "java": r"(?m)^[ \t]*import\s+(?:static\s+)?([\w.]+)",
    "csharp": r"(?m)^[ \t]*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;",
    "kotlin": r"(?m)^[ \t]*import\s+([\w.]+)",
    "swift": r"(?m)^[ \t]*import\s+([\w.]+)",
    "php": r"(?m)^[ \t]*use\s+([\w\\]+)|\b(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]",
    "c": r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"]+)[>\"]",
}
IMPORTS["typescript"], IMPORTS["cpp"] = IMPORTS["javascript"], IMPORTS["c"]
CONTAINERS = {"class", "interface", "struct", "enum", "trait", "impl"}
#: Words before a parenthesis that call nothing.
NO_CALLS = set("if for while switch catch return function sizeof typeof match when guard using lock foreach elseif else do try new throw async await yield import in of as is not and or func fn fun def class struct enum interface super this self defer select".split())

_COMPILED = {lang: [(kind, re.compile(p)) for kind, p in rules] for lang, rules in DEFINITIONS.items()}
_HIDDEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`", re.S)
_HIDDEN_SCRIPT = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_CALL = re.compile(rf"({_WORD})\s*(?:<[\w, ]*>)?\(")


def masked(text: str, language: str) -> str:
    """The text with comments and strings as blanks, line breaks kept."""
    hidden = _HIDDEN_SCRIPT if language in ("javascript", "typescript", "php") else _HIDDEN
    return hidden.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def block_end(text: str, at: int) -> int:
    """Where the block ends that begins at or after `at`; without a block, the end of the statement: a semicolon, or a line that nothing carries on."""
    depth = 0
    for m in _EDGES.finditer(text, at):
        c = m[0]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "\n":
            if depth <= 0 and not _CARRIED.search(text, max(at, m.start() - 200), m.start()) and not _CARRIES.match(text, m.end()):
                return m.start()
        elif c == ";" and depth <= 0:
            return m.end()
        elif c == "{":
            break
    else:
        return len(text)
    depth = 0
    for m in _BRACES.finditer(text, m.start()):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text)


_EDGES, _BRACES = re.compile(r"[{;\n()\[\]]"), re.compile(r"[{}]")
_CARRIED, _CARRIES = re.compile(r"(?:[,:=|&+<]|->|\b(?:extends|implements|where|throws))[ \t]*$"), re.compile(r"\s*(?:[{:=,|&]|->|extends\b|implements\b|where\b|throws\b)")


def parse(text: str, language: str) -> tuple[list, list, list]:
    """Symbols (name, kind, qualified, signature, doc, first, last, parent), calls (caller, callee, line), imports (name, module)."""
    bare = masked(text, language)
    line_of = _lines(text)
    found: dict = {}
    for kind, pattern in _COMPILED[language]:
        for m in pattern.finditer(bare):
            name = m["name"].rsplit("::", 1)[-1]
            at = m.end("name") - len(name)
            if name not in NO_CALLS and at not in found:
                found[at] = (name, kind, at, m.end())
    spans = [(at, block_end(bare, end), name, kind) for name, kind, at, end in sorted(found.values(), key=lambda f: f[2])]
    symbols, stack, names = [], [], {}
    for at, end, name, kind in spans:
        while stack and stack[-1][1] <= at:
            stack.pop()
        owner = next((s for s in reversed(stack) if s[3] in CONTAINERS), None)
        if kind == "function" and owner:
            kind = "method"
        qualified = f"{names[owner[0]]}.{name}" if owner else name
        names[at] = qualified
        start = bare.rfind("\n", 0, at) + 1
        head = re.split(r"[{;\n]", text[start:end], maxsplit=1)[0]
        if kind != "impl":
            symbols.append((name, kind, qualified, " ".join(head.split()), _doc(text, start), line_of(at), line_of(max(at, end - 1)), names[owner[0]] if owner else None))
        stack.append((at, end, name, kind))
    calls, open_, at = [], [], 0
    for m in _CALL.finditer(bare):
        if m[1] in NO_CALLS or m.start(1) in found:
            continue
        while at < len(spans) and spans[at][0] < m.start():  # both go forward through the text
            open_.append(spans[at])
            at += 1
        open_ = [s for s in open_ if s[1] > m.start()]
        inside = [s for s in open_ if s[3] != "impl"]
        if inside and inside[-1][3] == "interface":  # what it lists is declared, not called
            continue
        calls.append((names[inside[-1][0]] if inside else None, m[1], line_of(m.start())))
    modules = [next(g for g in m.groups() if g) for m in re.finditer(IMPORTS[language], text)]
    return symbols, calls, [(re.split(r"[./:\\]+", x)[-1], x) for x in modules]


def _lines(text: str):
    from bisect import bisect_right

    breaks = [m.end() for m in re.finditer("\n", text)]
    return lambda at: bisect_right(breaks, at) + 1


def _doc(text: str, start: int) -> str | None:
    """The comment lines right above a definition."""
    lines = []
    for line in reversed(text[:start].splitlines()):
        bare = line.strip()
        if not bare.startswith(("//", "/*", "*")):
            break
        lines.append(re.sub(r"^(?:///?|/\*\*?|\*/?)\s?|\s*\*/$", "", bare).strip())
    return "\n".join(x for x in reversed(lines) if x) or None
