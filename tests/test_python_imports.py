from loomwork.operators import store


def test_python_modules(spark):
    files = spark.createDataFrame([(p,) for p in ("a/b.py", "a/__init__.py", "a/c/__init__.py", "a/c/d.py", "top.py", "a/top.py", "a/b.py")], "path string")
    rows = [
        ("a/x.py", "a", "b", "a/b.py"), ("a/x.py", "..a", "c", "a/c/__init__.py"), ("a/x.py", ".c", "d", "a/c/d.py"), ("a/x.py", ".c", "f", "a/c/__init__.py"), ("a/x.py", "top", "f", "top.py"),
        ("a/y.py", "top", "f", "top.py"), ("a/c/z.py", "d", "f", "a/c/d.py"), ("a/x.py", "d", "f", None), ("a/x.py", ".b", None, "a/b.py"), ("a/x.py", "json", "loads", None), ("x.py", ".top", "f", "top.py"), ("a/x.py", None, "f", "a/__init__.py"),
    ]
    imports = spark.createDataFrame([r[:3] for r in rows] * 2, "from string, module string, name string")
    found = store.python_modules(imports, files)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(rows, key=repr)


def test_python_imports_of_a_folder_are_looked_up_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(store, "written", lambda df, name: kept.append(df) or df)
    imports = spark.createDataFrame([(f"a/x{k}.py", ".b", "f") for k in range(9)], "from string, module string, name string")
    found = store.python_modules(imports, spark.createDataFrame([("a/b.py",)], "path string"))
    assert found.where("target = 'a/b.py'").count() == 9
    assert kept[0].count() == 1
