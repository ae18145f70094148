"""Review-text analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a Column
expression) that leaves planning to Catalyst.  See README.md for the layout and
for the rules the operators follow at scale.
"""

from reviewmill.config import PRESETS, PlatformConfig
from reviewmill.session import build_session, materialize

__all__ = ["PRESETS", "PlatformConfig", "build_session", "materialize"]
