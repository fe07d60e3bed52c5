"""Status label table.

Fixed values: the six status labels, from the best score band to the worst,
plus the label of an unscored entity.  They must equal the reference's labels
for results to match; a different vocabulary can be passed to ``status_label``.
"""

from __future__ import annotations

# Fixed values — status labels, score bands [4.5, 5], [3.5, 4.5), [2.5, 3.5),
# [1.5, 2.5), [1, 1.5), and the unscored label.
DEFAULT_LABELS = ("genius", "smart", "normal", "dumb", "braindead", "unknown")
