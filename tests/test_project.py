"""Ignore rules against git itself, and the cached catalog's states."""

import random
import subprocess

import pytest

from weftline.sources import cached, ignore


def by_git(root, files, paths):
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("")
    for p, text in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)
    out = subprocess.run(["git", "-c", "core.quotePath=false", "check-ignore", "--no-index", "--stdin", "-z"], input="\0".join(paths), capture_output=True, text=True, cwd=root)
    return {p for p in out.stdout.split("\0") if p}


def by_rules(spark, files, paths):
    own = ignore.rules(spark.createDataFrame(list(files.items()), "path string, text string"))
    return {r.path for r in ignore.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), own).collect()}


def test_patterns_as_git_has_them(spark, tmp_path):
    """Anchors, folders, stars of all kinds, sets, escapes, blanks, comments, and what deeper files take back."""
    files = {
        ".gitignore": "# no\n\n*.o\n!keep.o\n/top\nmid/dle\nfold/\n**/deep\nall/**\na/**/z\nx**y\nq?\n[a-c]1\n[!a-c]2\n\\!bang\n\\#hash\nspace\\ \ntrail   \nesc\\*\nspecial.(+)$\n*.tmp\n!/sub/ok.tmp\nab[]]c\nset[^x]\n",
        "sub/.gitignore": "!*.o\n/only\nkeepme/\n!fold/\nnested/*.log\n",
        "sub/more/.gitignore": "*\n!*.md\n!.gitignore\n",
    }
    names = ["a.o", "keep.o", "top", "mid/dle", "fold", "deep", "all/x", "all/x/y", "a/z", "a/b/z", "a/b/c/z", "xy", "xqqy", "q1", "q", "a1", "d1", "a2", "d2", "!bang", "#hash", "space ", "trail", "esc*", "escx", "special.(+)$", "specialx(+)$", "b.tmp", "ab]c", "setx", "sety", "all"]
    paths = set()
    for n in names:
        paths |= {f"1{k}/{n}" if k else n for k in range(2)} | {f"sub/{n}", f"sub/more/{n}", f"fold/{n}", f"other/fold/{n}"}
    paths |= {"sub/ok.tmp", "sub/only", "sub/in/only", "sub/keepme/f", "sub/nested/a.log", "sub/nested/b/a.log", "sub/more/r.md", "sub/more/in/r.md"}
    paths = sorted(p for p in paths if not any(o.startswith(p + "/") for o in paths))
    got, want = by_rules(spark, files, paths), by_git(tmp_path, files, paths)
    assert 30 < len(want) < len(paths) - 30
    assert sorted(got ^ want) == []


@pytest.mark.parametrize("seed", range(3))
def test_random_rules_as_git_has_them(spark, tmp_path, seed):
    r = random.Random(seed)
    parts = ["a", "b", "ab", "*", "**", "?", "a*", "[ab]", "*.c", "d"]
    pattern = lambda: ("!" if r.random() < 0.3 else "") + ("/" if r.random() < 0.2 else "") + "/".join(r.choice(parts) for _ in range(r.choice((1, 1, 2, 3)))) + ("/" if r.random() < 0.25 else "")
    files = {f"{d}.gitignore": "\n".join(pattern() for _ in range(r.choice((2, 4)))) for d in ("", "a/", "a/b/", "d/")}
    names = ["a", "b", "ab", "d", "x.c", "bb"]
    paths = {"/".join(r.choice(names) for _ in range(r.choice((1, 2, 3, 4)))) for _ in range(300)}
    paths = sorted(p for p in paths if p + "/" not in {f"{d}/" for d in ("a", "a/b", "d")} and not any(o.startswith(p + "/") for o in paths))
    assert sorted(by_rules(spark, files, paths) ^ by_git(tmp_path, files, paths)) == [], files


def test_ignored_of_nothing(spark):
    none = spark.createDataFrame([], "path string, text string")
    assert by_rules(spark, {".gitignore": "# only\n"}, ["a"]) == set()
    assert ignore.ignored(none.select("path"), ignore.rules(none)).collect() == []


def test_cached_catalog(spark, tmp_path):
    folder, calls = f"{tmp_path}/c", []
    rows = lambda n: spark.createDataFrame([(n,)], "id int")

    def fetch(n, fails=False):
        def run():
            calls.append(n)
            if fails:
                raise OSError("no network")
            return rows(n) if n else rows(1).limit(0)

        return run

    ask = lambda n, at, **x: (lambda got: ([r.id for r in got[0].collect()], got[1]))(cached.cached(spark, folder, fetch(n, **x), at, empty=rows(1).limit(0)))
    assert ask(1, 0, fails=True) == ([], "none")
    assert ask(0, 0) == ([], "fetched") and ask(1, 1) == ([1], "fetched")  # an empty snapshot is never fresh
    assert ask(2, 3600) == ([1], "fresh") and calls == [1, 0, 1]
    assert ask(2, 3601, fails=True) == ([1], "stale") and ask(2, 3601) == ([2], "fetched") and ask(3, 3602) == ([2], "fresh")
    with pytest.raises(OSError, match="network"):
        cached.cached(spark, f"{tmp_path}/d", fetch(1, fails=True), 0)
