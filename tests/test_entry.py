import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_works_without_the_text_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'temporal_lane_top' in e.queries() and not [n for n in e.queries() if n.startswith('op')]; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
