import __spark_entry__ as entry


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_llm(tmp_path):
    """A copy of the repository without the llm folders and the pipeline still imports."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "wardspan"), tmp_path / "wardspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; assert 'cloud_user_day' in e.queries() and not any(n.startswith('op1_') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_other_queries_stay_without_a_library_of_llm():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; assert 'cloud_user_day' in e.queries() and 'op4_licenses' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": root}, check=True)
