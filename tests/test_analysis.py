import pytest

from reviewlake.analysis.structure import parse

# A small stock-keeping module in every language: a type, what it offers, and what it keeps to itself.
SYMBOLS = {
    "go": ("package stock\n\ntype Shelf struct {\n\tslots int\n}\n\nfunc NewShelf(n int) Shelf {\n\treturn Shelf{n}\n}\n\nfunc countFree(s Shelf) int { return s.slots }\n", {"Shelf": (True, "class"), "NewShelf": (True, "function"), "countFree": (False, "function")}),
    "rust": ("enum Colour { Red, Blue }\npub struct Shelf { slots: u32 }\nimpl Shelf {\n    pub fn free(&self) -> u32 { self.slots }\n}\npub fn open_shelf() -> Shelf { Shelf { slots: 3 } }\nfn dust() {}\n", {"Colour": (False, "enum"), "Shelf": (True, "class"), "free": (True, "method"), "open_shelf": (True, "function"), "dust": (False, "function")}),
    "java": ("interface Countable {\n  int total();\n}\n\npublic class Shelf {\n  private int slots;\n  public int total() { return slots; }\n  private void dust() { slots = 0; }\n}\n", {"Countable": (False, "interface"), "Shelf": (True, "class"), "total": (True, "method"), "dust": (False, "method")}),
    "csharp": ("namespace Stock {\n  public class Shelf {\n    public int Total() { return 4; }\n    private void Dust() { }\n  }\n}\n", {"Shelf": (True, "class"), "Total": (True, "method"), "Dust": (False, "method")}),
    "c": ("struct shelf { int slots; };\nstatic int dust(int n) { return n - 1; }\nint shelf_total(struct shelf *s) { return s->slots; }\n", {"shelf": (True, "class"), "dust": (False, "function"), "shelf_total": (True, "function")}),
    "cpp": ("int restock(int n) { return n + 1; }\nnamespace stock {\nclass Shelf {\npublic:\n  int total(int extra) { return slots + extra; }\nprivate:\n  int slots;\n};\n}\n", {"restock": (True, "function"), "Shelf": (True, "class"), "total": (True, "method")}),
    "php": ("<?php\nfunction restock($n) { return $n + 1; }\nclass Shelf {\n  private function dust() { return 0; }\n  public function total($extra) { return $extra; }\n}\n", {"restock": (True, "function"), "Shelf": (True, "class"), "dust": (False, "method"), "total": (True, "method")}),
    "ruby": ("module Stock\nend\ndef restock(n)\n  n + 1\nend\nclass Shelf\n  def total(extra)\n    extra\n  end\nend\n", {"Stock": (True, "class"), "restock": (True, "function"), "Shelf": (True, "class"), "total": (True, "method")}),
    "kotlin": ("fun restock(n: Int) = n + 1\n\nclass Shelf(val slots: Int) {\n  private fun dust() {}\n  fun total(extra: Int): Int { return slots + extra }\n}\n", {"restock": (True, "function"), "Shelf": (True, "class"), "dust": (False, "method"), "total": (True, "method")}),
    "swift": ("func restock(_ n: Int) -> Int { return n + 1 }\nclass Shelf {\n  private func dust() {}\n  func total() -> Int { return 4 }\n}\n", {"restock": (True, "function"), "Shelf": (True, "class"), "dust": (False, "method"), "total": (True, "method")}),
    "scala": ("class Shelf(slots: Int) {\n  private def dust(): Int = 0\n  def total(extra: Int): Int = slots + extra\n}\nobject Stock {\n  def restock(n: Int): Int = n + 1\n}\n", {"Shelf": (True, "class"), "dust": (False, "method"), "total": (True, "method"), "restock": (True, "method")}),
    "bash": ("restock() {\n  echo \"$1\"\n}\n\nfunction dust {\n  rm -f \"$1\"\n}\n", {"restock": (True, "function"), "dust": (True, "function")}),
    "typescript": ("import { Slot } from './slot';\nimport fs from 'node:fs';\nimport { read as load } from './disk';\n\nexport const LIMIT = 12;\nconst dust = (n) => n - 1;\nexport class Shelf {\n  total() { return LIMIT; }\n}\nexport function restock(n: number) { return n + 1; }\n", {"LIMIT": (True, "const"), "dust": (False, "function"), "Shelf": (True, "class"), "total": (False, "method"), "restock": (True, "function")}),
    "python": ("from .slot import Slot\n\n\nclass Shelf:\n    def total(self):\n        return 4\n\n\ndef _dust(n):\n    return n - 1\n\n\ndef restock(n):\n    return n + 1\n", {"Shelf": (True, "class"), "total": (False, "method"), "_dust": (False, "function"), "restock": (True, "function")}),
}

# One loop with a condition of two parts in it, and a condition beside the loop: 1 + (2 + 1) + 1.
SCORES = {
    "typescript": "function tally(rows) {\n  let n = 0;\n  while (n < 9) {\n    if (rows[n] || n > 3) { n += 2; }\n    n += 1;\n  }\n  if (n > 8) { n = 8; }\n  return n;\n}\n",
    "javascript": "const tally = (rows) => {\n  let n = 0;\n  for (const r of rows) {\n    if (r.live && r.size) { n += r.size; }\n  }\n  if (n < 0) { n = 0; }\n  return n;\n};\n",
    "python": "def tally(rows):\n    n = 0\n    for r in rows:\n        if r.live or r.size:\n            n += 1\n    if n > 8:\n        n = 8\n    return n\n",
    "go": "package stock\n\nfunc tally(rows []int) int {\n\tn := 0\n\tfor _, r := range rows {\n\t\tif r > 1 || r < -1 {\n\t\t\tn += r\n\t\t}\n\t}\n\tif n > 8 {\n\t\tn = 8\n\t}\n\treturn n\n}\n",
    "rust": "fn tally(rows: &[i32]) -> i32 {\n    let mut n = 0;\n    for r in rows {\n        if *r > 1 || *r < -1 { n += r; }\n    }\n    if n > 8 { n = 8; }\n    n\n}\n",
    "java": "class Stock {\n  int tally(int[] rows) {\n    int n = 0;\n    for (int r : rows) {\n      if (r > 1 || r < -1) { n += r; }\n    }\n    if (n > 8) { n = 8; }\n    return n;\n  }\n}\n",
    "csharp": "class Stock {\n  int tally(int[] rows) {\n    int n = 0;\n    foreach (var r in rows) {\n      if (r > 1 && r < 7) { n += r; }\n    }\n    if (n > 8) { n = 8; }\n    return n;\n  }\n}\n",
    "cpp": "int tally(const int *rows, int m) {\n  int n = 0;\n  while (n < m) {\n    if (rows[n] > 1 || rows[n] < -1) { n += 2; }\n    n += 1;\n  }\n  if (n > 8) { n = 8; }\n  return n;\n}\n",
    "c": "int tally(const int *rows, int m) {\n  int n = 0;\n  while (n < m) {\n    if (rows[n] > 1 && m > 2) { n += 2; }\n    n += 1;\n  }\n  if (n > 8) { n = 8; }\n  return n;\n}\n",
    "php": "<?php\nfunction tally($rows) {\n  $n = 0;\n  foreach ($rows as $r) {\n    if ($r > 1 || $r < -1) { $n += $r; }\n  }\n  if ($n > 8) { $n = 8; }\n  return $n;\n}\n",
    "ruby": "def tally(rows)\n  n = 0\n  while n < 9\n    if rows[n] || n > 3\n      n += 2\n    end\n    n += 1\n  end\n  if n > 8\n    n = 8\n  end\n  n\nend\n",
    "kotlin": "fun tally(rows: List<Int>): Int {\n  var n = 0\n  for (r in rows) {\n    if (r > 1 || r < -1) { n += r }\n  }\n  if (n > 8) { n = 8 }\n  return n\n}\n",
    "swift": "func tally(_ rows: [Int]) -> Int {\n  var n = 0\n  for r in rows {\n    if r > 1 || r < -1 { n += r }\n  }\n  if n > 8 { n = 8 }\n  return n\n}\n",
    "scala": "object Stock {\n  def tally(rows: Seq[Int]): Int = {\n    var n = 0\n    for (r <- rows) {\n      if (r > 1 || r < -1) { n += r }\n    }\n    if (n > 8) { n = 8 }\n    n\n  }\n}\n",
    "bash": "tally() {\n  n=0\n  for r in \"$@\"; do\n    if [ \"$r\" -gt 1 ] && [ \"$r\" -lt 7 ]; then\n      n=$((n + r))\n    fi\n  done\n  if [ \"$n\" -gt 8 ]; then\n    n=8\n  fi\n  echo \"$n\"\n}\n",
}


@pytest.mark.parametrize("lang", SYMBOLS)
def test_symbols(lang):
    source, want = SYMBOLS[lang]
    got = {s.name: (s.exported, s.kind) for s in parse(lang, source).symbols}
    assert {k: got.get(k) for k in want} == want


@pytest.mark.parametrize("lang", SCORES)
def test_complexity(lang):
    assert {f.name: f.score for f in parse(lang, SCORES[lang]).functions}["tally"] == 5


def test_straight_code_scores_nothing():
    assert [f.score for f in parse("typescript", "function sum(a, b) {\n  return a + b;\n}\n").functions] == [0]


def test_imports():
    got = {i.source: i.names for i in parse("typescript", SYMBOLS["typescript"][0]).imports}
    assert got == {"./slot": ["Slot"], "node:fs": ["fs"], "./disk": ["load"]}
    assert parse("python", "from ..stock import shelf as s\nimport os.path\n").imports == [(["s"], "..stock"), (["os.path"], "os.path")]
    assert parse("go", 'import (\n"strings"\n"stock/shelf"\n)\n').imports == [([], "strings"), ([], "stock/shelf")]


@pytest.mark.parametrize("source", ["", "class {", "\x00", "}]){", '"', "<!--"])
@pytest.mark.parametrize("lang", ["python", "typescript", "rust", "ruby", "bash", "cpp", "other"])
def test_odd_sources_do_not_fail(lang, source):
    parse(lang, source)
