"""Source code to tables of symbols, calls and imports; repository files and their languages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by extension, and the limits of one file.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "kt": "kotlin", "swift": "swift"}
MOST_BYTES, MOST_SYMBOLS, MOST_CALLS, MOST_IMPORTS = 5_000_000, 5000, 20_000, 2000


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.create_map(*pairs)[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))]


def source_files(files: DataFrame) -> DataFrame:
    """Files of a known language that are neither too large nor binary, with their content's hash."""
    rows = files.withColumn("language", language(F.col("path"))).where("language IS NOT NULL")
    return rows.where((F.octet_length("content") <= MOST_BYTES) & ~F.col("content").contains("\x00")).withColumn("content_hash", F.sha1("content"))


def _python(text: str):
    """Symbols (name, kind, qualified, signature, doc, first, last, parent), calls (caller, callee, line), imports (name, module)."""
    import ast

    symbols, calls, imports = [], [], []

    def walk(node, parent, owner):
        for child in ast.iter_child_nodes(node):
            here = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if parent and parent[1] == "class" else "function"
                qualified = f"{parent[0]}.{child.name}" if parent else child.name
                signature = f"class {child.name}" if kind == "class" else f"def {child.name}({ast.unparse(child.args)})"
                symbols.append((child.name, kind, qualified, signature, ast.get_docstring(child), child.lineno, child.end_lineno, parent[0] if parent else None))
                walk(child, (qualified, kind), qualified)
                continue
            if isinstance(child, ast.Call):
                name = child.func.attr if isinstance(child.func, ast.Attribute) else getattr(child.func, "id", None)
                if name:
                    calls.append((here, name, child.lineno))
            elif isinstance(child, ast.Import):
                imports.extend((a.name, a.name) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.extend((a.name, "." * child.level + (child.module or "")) for a in child.names)
            walk(child, parent, here)

    try:
        walk(ast.parse(text), None, None)
    except (SyntaxError, ValueError, RecursionError):
        return [], [], []
    return symbols[:MOST_SYMBOLS], calls[:MOST_CALLS], imports[:MOST_IMPORTS]


ROWS = "path string, row string, name string, kind string, qualified_name string, signature string, docstring string, start_line int, end_line int, parent string, module string"


def parsed(files: DataFrame) -> DataFrame:
    """Rows of kind `symbol`, `call` (qualified_name is the caller) and `import` of source files; Python by its grammar, languages with braces by patterns, others not at all."""
    from lodewell.sources import braces

    def read(language: str, text: str):
        if language == "python":
            return _python(text)
        symbols, calls, imports = braces.parse(text, language)
        return symbols[:MOST_SYMBOLS], calls[:MOST_CALLS], imports[:MOST_IMPORTS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text, language in zip(batch["path"], batch["content"], batch["language"]):
                symbols, calls, imports = read(language, text or "")
                out += [(path, "symbol", n, k, q, s, d, a, b, p, None) for n, k, q, s, d, a, b, p in symbols]
                out += [(path, "call", n, None, c, None, None, line, None, None, None) for c, n, line in calls]
                out += [(path, "import", n, None, None, None, None, None, None, None, m) for n, m in imports]
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])
            yield frame.astype({"start_line": "Int32", "end_line": "Int32"})

    known = F.col("language").isin("python", *braces.DEFINITIONS)
    return files.where(known).select("path", "content", "language").mapInPandas(run, ROWS)


def body(content: Column, first: Column, last: Column, most: int = 200) -> Column:
    """Lines first to last of a text, `most` of them at most."""
    return F.array_join(F.slice(F.split(content, "\n"), first, F.least(last - first + 1, F.lit(most))), "\n")


def fnv1a(data: bytes) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for byte in data:
        h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def body_simhash(text: Column) -> Column:
    """SimHash of a body's word 3-grams without comments and strings, by FNV-1a; 0 below three words."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        import re

        import numpy as np

        def one(t):
            t = re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'', " s ", re.sub(r"//[^\n]*|#[^\n]*|/\*.*?\*/", " ", t or "", flags=re.S))
            words = re.findall(r"\w+|[^\w\s]", t)
            if len(words) < 3:
                return 0
            grams = np.array([fnv1a(" ".join(words[i : i + 3]).encode()) for i in range(len(words) - 2)], "<u8")
            bits = np.unpackbits(grams.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(grams), bitorder="little").view("<i8")[0])

        return texts.map(one)

    return run(text)
