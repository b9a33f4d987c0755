"""Symbols and uses from tokens: what a line pattern can't tell, as comments, strings, spans and scopes.

Python files go through the standard parser. For other languages a lexer drops
comments and the text of strings; declarations are found among the tokens and end with their
brackets. A file that can't be read so yields None, and line patterns take over.
"""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize as python_tokens
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, number, text or mark
    text: str
    line: int


_WORD, _NUMBER = r"(?P<word>[A-Za-z_$][A-Za-z0-9_$]*)", r"(?P<number>[0-9][A-Za-z0-9_.]*)"
_C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"
_GRAMMARS = {
    "script": (_C_COMMENT, f"{_DOUBLE}|{_SINGLE}"),
    "go": (_C_COMMENT, rf"{_DOUBLE}|`[^`]*`?|'(?:\\.[^']*|[^'\\\n])'"),
    "rust": (_C_COMMENT, r'r(#*)".*?"\1|"(?:\\.|[^"\\])*"?|' + r"'(?:\\.[^']*|[^'\\\n])'"),
    "java": (_C_COMMENT, rf'""".*?"""|{_DOUBLE}|{_SINGLE}'),
    "php": (_C_COMMENT + r"|\#[^\n]*", f"{_DOUBLE}|{_SINGLE}"),
    "ruby": (r"\#[^\n]*|^=begin.*?^=end", f"{_DOUBLE}|{_SINGLE}"),
}
_FAMILY = {"typescript": "script", "javascript": "script", "go": "go", "rust": "rust", "java": "java", "c": "java", "cpp": "java", "csharp": "java", "php": "php", "ruby": "ruby"}
_LEXERS = {name: re.compile(f"(?P<comment>{c})|(?P<string>{s})|{_WORD}|{_NUMBER}|(?P<line>\n)|(?P<mark>[^\\sA-Za-z0-9_$])", re.S | re.M) for name, (c, s) in _GRAMMARS.items()}
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.S)

# Words that are never names, by language.
_SCRIPT_WORDS = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static async await of as interface type implements private protected public readonly abstract declare namespace keyof get set undefined string number boolean any unknown never object symbol bigint from"
KEYWORDS = {
    "typescript": frozenset(_SCRIPT_WORDS.split()), "javascript": frozenset(_SCRIPT_WORDS.split()),
    "go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false".split()),
    "rust": frozenset("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn".split()),
    "java": frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()),
    "ruby": frozenset("alias and begin break case class def defined do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield".split()),
    "c": frozenset("auto break case char const continue default do double else enum extern float for goto if inline int long register return short signed sizeof static struct switch typedef union unsigned void volatile while".split()),
}
KEYWORDS |= {"cpp": KEYWORDS["c"] | KEYWORDS["java"], "csharp": KEYWORDS["java"], "php": KEYWORDS["java"]}
#: Whether a word after a dot is a use: always, never, or where it is called.
_DOTTED = {"typescript": "called", "javascript": "called", "go": "never", "rust": "never", "c": "never", "cpp": "never"}
_STATEMENT = frozenset("export import const let var function class interface type enum abstract declare namespace async if for while return switch try throw".split())
_BEFORE_VALUE = frozenset("( , = : [ ! & | ? { } ; + - * % ~ ^ < >".split())
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def tokens(content: str, language: str) -> list[Token]:
    lexer = _LEXERS[_FAMILY[language]]
    script = _FAMILY[language] == "script"
    out: list[Token] = []
    at, line, templates = 0, 1, []  # templates: the bracket depth at which each open ${ ends
    depth = 0

    def template(begin: int) -> int:
        """Past the text of a template, up to its end or into its next expression."""
        end = _TEMPLATE.match(content, begin).end()
        if content.startswith("${", end):
            templates.append(depth)
            return end + 2
        return end + 1

    while at < len(content):
        c = content[at]
        if script and (c == "`" or (c == "}" and templates and templates[-1] == depth)):
            if c == "}":
                templates.pop()
            end = template(at + 1)
            out.append(Token("text", "`", line))
        elif script and c == "/" and (not out or out[-1].text in _BEFORE_VALUE or out[-1].text in ("return", "typeof", "case")) and (m := _REGEX.match(content, at)):
            end = m.end()
            out.append(Token("text", "/", line))
        elif m := lexer.match(content, at):
            end = m.end()
            kind = m.lastgroup if m.lastgroup in ("word", "number", "mark") else "text" if m["string"] else None
            if kind:
                out.append(Token(kind, m[0] if kind != "text" else m[0][:1], line))
                depth += (m[0] == "{") - (m[0] == "}") if kind == "mark" else 0
        else:
            end = at + 1
        line += content.count("\n", at, end)
        at = end
    return out


def closing(code: list[Token]) -> dict[int, int]:
    """For each opening bracket the place of the one that closes it."""
    out, stack = {}, []
    for k, t in enumerate(code):
        if t.kind == "mark":
            if t.text in _PAIRS:
                stack.append(k)
            elif t.text in _PAIRS.values():
                while stack and _PAIRS[code[stack[-1]].text] != t.text:
                    stack.pop()
                if stack:
                    out[stack.pop()] = k
    return out


def _end(code: list[Token], close: dict[int, int], k: int, body: bool) -> int:
    """The last token of a declaration whose name is at k: its body's bracket, a semicolon, or what stands before the next statement."""
    i = k + 1
    while i < len(code):
        t = code[i]
        if t.kind == "mark" and t.text in _PAIRS and i in close:
            if t.text == "{" and body:
                return close[i]
            i = close[i]
        elif t.text == ";" and t.kind == "mark":
            return i
        elif t.text == "}" and t.kind == "mark" or (t.line > code[i - 1].line and t.kind == "word" and t.text in _STATEMENT and code[i - 1].text not in ("=", "=>", "(", ",", "|", "&", "?", ":", "+")):
            return i - 1
        i += 1
    return len(code) - 1


def _symbol(name: str, kind: str, line: int, last: int, exported: bool) -> dict:
    return {"name": name, "kind": kind, "line": line, "end_line": last, "exported": exported}


_DECLARES = {"class": "class", "interface": "interface", "enum": "enum", "function": "function", "type": "type"}


def _script(code: list[Token]) -> tuple[list[dict], set[int]]:
    close, found, named = closing(code), [], set()
    listed: set[str] = set()
    for k, t in enumerate(code):
        if t.kind != "word":
            continue
        before, after = (code[k - 1] if k else None), (code[k + 1] if k + 1 < len(code) else None)
        if t.text == "export" and after and after.text == "{" and k + 1 in close:
            listed |= {x.text for x in code[k + 2 : close[k + 1]] if x.kind == "word" and x.text != "as"}
        name, kind = None, None
        if t.text in _DECLARES and not (before and before.text in (".", "=", "(", ",", ":", "?", "return", "import")):
            i = k + 2 if t.text == "function" and after and after.text == "*" else k + 1
            if i < len(code) and code[i].kind == "word" and (t.text != "type" or (i + 1 < len(code) and code[i + 1].text in ("=", "<"))):
                name, kind = i, _DECLARES[t.text]
        elif t.text in ("const", "let", "var") and after and after.kind == "word" and after.text != "enum":
            name, kind = k + 1, "variable"
        if name is not None:
            first = k
            while first and code[first - 1].text in ("export", "default", "async", "abstract", "declare", "const") and code[first - 1].kind == "word":
                first -= 1
            exported = any(x.text == "export" for x in code[first:k])
            last = _end(code, close, name, kind != "variable" and kind != "type")
            start = code[name if kind == "variable" else k].line
            if kind in ("class", "function") and code[k - 1].text in ("async", "abstract") and k:
                start = code[k - 1].line
            found.append((name, _symbol(code[name].text, kind, start, code[last].line, exported)))
        elif t.text not in KEYWORDS["typescript"] - {"get", "set", "of", "from", "type", "as", "async"} and after and after.text in ("(", "<") and not (before and before.text in (".", "function", "new", "*", "@")):
            i = k + 1
            if after.text == "<":
                while i < len(code) and code[i].text != "(" and code[i].line == t.line:
                    i += 1
            if i in close and code[i].text == "(":
                j = close[i] + 1
                if j < len(code) and code[j].text == ":":
                    typed = j + 1
                    while j + 1 < len(code) and code[j + 1].text not in (";", "}", ")", ",", "=") and not (code[j + 1].text == "{" and j + 1 > typed):
                        j = close.get(j + 1, j + 1)
                    j += 1
                if j < len(code) and code[j].text == "{" and j in close:
                    found.append((k, _symbol(t.text, "method", t.line, code[close[j]].line, False)))
    for k, s in found:
        named.add(k)
        s["exported"] |= s["name"] in listed
    return [s for _, s in found if s["name"] not in ("constructor", "new", "this")], named


# Fixed values: (kind, word) of declarations; a receiver makes a function a method.
_ITEMS = {
    "go": [("function", "func"), ("type", "type"), ("constant", "const")],
    "rust": [("function", "fn"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("constant", "const"), ("type", "type")],
    "java": [("class", "class"), ("interface", "interface"), ("enum", "enum")],
}


def _items(code: list[Token], language: str) -> tuple[list[dict], set[int]]:
    close, found, named = closing(code), [], set()
    kinds = {w: kind for kind, w in _ITEMS[language]}
    for k, t in enumerate(code[:-1]):
        if t.kind != "word" or t.text not in kinds or (k and code[k - 1].text == "."):
            continue
        i, kind = k + 1, kinds[t.text]
        if language == "go" and code[i].text == "(" and i in close:
            if t.text != "func":
                continue
            i, kind = close[i] + 1, "method"
        if i < len(code) and code[i].kind == "word" and code[i].text not in KEYWORDS[language] and (language != "go" or t.text != "type" or code[i + 1 : i + 2]):
            last = _end(code, close, i, True)
            if language == "go" and t.text in ("type", "const") and not any(x.text == "{" for x in code[i : last + 1]):
                last = max((j for j in range(i, len(code)) if code[j].line == code[i].line), default=i)
            found.append(_symbol(code[i].text, kind, t.line, code[last].line, language == "rust" and bool(k) and code[k - 1].text == "pub"))
            named.add(i)
    return found, named


def _python(content: str) -> tuple[list[dict], list[dict]] | None:
    try:
        tree = ast.parse(content)
        words = [t for t in python_tokens.generate_tokens(io.StringIO(content).readline) if t.type == python_tokens.NAME and not keyword.iskeyword(t.string)]
    except (SyntaxError, ValueError, RecursionError, python_tokens.TokenError):
        return None
    found, names = [], set()
    for node in ast.walk(tree):
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            found.append((node.lineno, node.col_offset, _symbol(node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, node.end_lineno, False)))
    found.sort(key=lambda x: x[:2])
    defined = {(s["line"], s["name"]) for *_, s in found}
    for t in words:
        if (t.start[0], t.string) in defined and re.search(r"\b(?:def|class)\s+$", t.line[: t.start[1]]):
            names.add(t.start)
    return [s for *_, s in found], _uses([(t.string, t.start[0]) for t in words if t.start not in names])


def _uses(words: list[tuple[str, int]]) -> list[dict]:
    return [{"name": w, "line": k} for w, k in dict.fromkeys((w, k) for w, k in words if len(w) > 1)]


def first_of_each_name(symbols: list[dict]) -> list[dict]:
    out: dict[str, dict] = {}
    for s in symbols:
        if len(s["name"]) > 1:
            out.setdefault(s["name"], s)
    return list(out.values())


def available(language: str) -> bool:
    """Whether symbols come from tokens; uses do in more languages."""
    return language == "python" or language in _ITEMS or _FAMILY.get(language) == "script"


def scan(content: str, language: str) -> tuple[list[dict] | None, list[dict] | None]:
    """(symbols, uses), each None where the language has none of its own or the content can't be read."""
    if language == "python":
        got = _python(content)
        return (first_of_each_name(got[0]), got[1]) if got else (None, None)
    if language not in _FAMILY or not content.strip():
        return None, None
    code = tokens(content, language)
    found, named = _script(code) if _FAMILY[language] == "script" else _items(code, language) if language in _ITEMS else (None, set())
    dotted, words = _DOTTED.get(language, "always"), []
    for k, t in enumerate(code):
        if t.kind == "word" and k not in named and t.text not in KEYWORDS[language]:
            called = k + 1 < len(code) and code[k + 1].text == "("
            if not (k and code[k - 1].text == ".") or dotted == "always" or (dotted == "called" and called):
                words.append((t.text, t.line))
    return (first_of_each_name(found) if found is not None else None), _uses(words)
