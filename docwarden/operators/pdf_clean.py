"""Active content taken out of PDFs by walking their objects, and cleaned files that open.

The walk needs the objects of one file only, so it is a function of the row: nothing is exchanged. Three scopes:

``everywhere``: script, launch, submit and import keys of all dictionaries, and annotation actions of these types.
``scoped``: what the catalog, its names, forms and viewer preferences and the pages hold, by the path to it; then
scripts anywhere in reach, metadata and the document information. Objects that nothing leads to any more are left out.
``catalog``: the scoped keys of catalog, names and forms only.

A cleaned file is written anew: header, the objects that stay, and a table with their offsets. Nothing that was cut is
left in it. ``keep_original`` instead appends the changed file as an update behind the untouched old bytes.

Defined cases: bytes without a header, a catalog or readable objects, encrypted files and null contents give a null
result; a reference to an object that is not there is no value; cycles end where they close; a file that holds nothing to
cut comes back as it was.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docwarden.functions import fixed
from docwarden.session import small_batches
from docwarden.sources import pdf_graph
from docwarden.sources.pdf_graph import Pdf, Value, drop

COUNTERS = ("js", "actions", "annotations", "embedded_files", "richmedia")
RESULT = "clean binary, removed array<string>, " + ", ".join(f"{c} int" for c in COUNTERS)


class _Cut:
    """Labels and counters of what was taken out of one file."""

    def __init__(self, pdf: Pdf) -> None:
        self.pdf = pdf
        self.removed: set[str] = set()
        self.counts = dict.fromkeys(COUNTERS, 0)

    def key(self, holder: Value | None, key: str, label: str, counter: str | None = None) -> bool:
        if holder is None or holder.kind != "dict" or drop(holder, key) is None:
            return False
        self.removed.add(label)
        if counter:
            self.counts[counter] += 1
        return True

    def catalog(self) -> None:
        get, root = self.pdf.get, self.pdf.objects[self.pdf.root].value
        self.key(root, "/OpenAction", "OpenAction", "actions")
        self.key(root, "/AA", "Catalog.AA", "actions")
        names = get(root, "/Names")
        self.key(names, "/EmbeddedFiles", "Names.EmbeddedFiles", "embedded_files")
        self.key(names, "/JavaScript", "Names.JavaScript", "js")
        form = get(root, "/AcroForm")
        if form is not None and form.kind == "dict":
            for key in fixed.PDF_FORM_KEYS:
                self.key(form, f"/{key}", f"AcroForm.{key}")
            # a form counts as two scripts and an action, whatever it holds
            self.counts["js"] += 2
            self.counts["actions"] += 1
        self.key(root, "/Outlines", "Outlines")
        self.key(root, "/PageLabels", "PageLabels")

    def scripts(self) -> None:
        for number in sorted(pdf_graph.reachable(self.pdf)):
            for holder in pdf_graph.dicts(self.pdf.objects[number].value):
                for key in ("/JS", "/JavaScript"):
                    self.key(holder, key, "JS", "js")

    def pages(self) -> list[Value]:
        """Leaves of the page tree, each once."""
        tree = self.pdf.objects[self.pdf.root].value.inner.get("/Pages")
        todo, seen, leaves = [tree[1]] if tree else [], set(), []
        while todo:
            value = todo.pop()
            if value.kind == "ref":
                if value.inner in seen:
                    continue
                seen.add(value.inner)
            node = self.pdf.resolve(value)
            if node is None or node.kind != "dict":
                continue
            kids = self.pdf.get(node, "/Kids")
            if kids is not None and kids.kind == "array":
                todo += reversed(kids.inner)
            else:
                leaves.append(node)
        return leaves

    def page(self, page: Value) -> None:
        self.key(page, "/AA", "Page.AA", "actions")
        self.key(page, "/RichMediaContent", "Page.RichMediaContent", "richmedia")
        notes = self.pdf.get(page, "/Annots")
        if notes is not None:
            count = len(notes.inner) if notes.kind == "array" else 1
            self.key(page, "/Annots", f"Annots({count})")
            self.counts["annotations"] += count

    def scoped(self) -> None:
        self.catalog()
        self.scripts()
        for page in self.pages():
            self.page(page)
        root = self.pdf.objects[self.pdf.root].value
        preferences = self.pdf.get(root, "/ViewerPreferences")
        if preferences is not None and preferences.kind == "dict":
            for key in list(preferences.inner):
                self.key(preferences, key, f"ViewerPreferences.{key[1:]}")
        self.key(root, "/Metadata", "Metadata")
        self.key(self.pdf.trailer, "/Info", "Info")

    def everywhere(self) -> None:
        for one in self.pdf.objects.values():
            for holder in pdf_graph.dicts(one.value):
                for key in fixed.PDF_STRIP_KEYS:
                    self.key(holder, key, key, "js" if "JS" in key or "Script" in key else "actions")
                action = self.pdf.get(holder, "/A")
                kind = self.pdf.get(action, "/S")
                if kind is not None and kind.inner in fixed.PDF_STRIP_ACTIONS:
                    self.key(holder, "/A", f"/A{kind.inner}", "actions")


def _one(content: bytes | None, scope: str, keep_original: bool) -> tuple | None:
    try:
        pdf = Pdf(content or b"")
        if pdf.trailer is not None and "/Encrypt" in pdf.trailer.inner:
            return None
        cut = _Cut(pdf)
        getattr(cut, scope)()
        counts = [cut.counts[c] for c in COUNTERS]
        if not cut.removed:
            return (content, [], *counts)
        stays = pdf_graph.reachable(pdf) if scope == "scoped" else set(pdf.objects)
        clean = pdf_graph.write(pdf, stays, append=keep_original, info=scope != "scoped")
        return (clean, sorted(cut.removed), *counts)
    except (pdf_graph.Unreadable, RecursionError):
        return None


def cleaned(content: Column, scope: str = "scoped", keep_original: bool = False) -> Column:
    """Struct of the cleaned file, what was removed (distinct, sorted) and the five counters; null for what is no readable PDF."""
    if scope not in ("everywhere", "scoped", "catalog"):
        raise ValueError(f"unknown scope {scope}")

    small_batches()

    @F.pandas_udf(RESULT)
    def run(contents: pd.Series) -> pd.DataFrame:
        names = ["clean", "removed", *COUNTERS]
        rows = [_one(c, scope, keep_original) or (None,) * len(names) for c in contents]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({c: "Int32" for c in COUNTERS})

    return run(content)
