"""Fixed values that the operators share."""

#: Severity of a bug by its importance.
SEVERITY = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1, "Wishlist": 0, "Unknown": 0, "Undecided": 0}
#: Order in which bugs are worked on, by importance.
PRECEDENCE = {"Critical": 6, "High": 5, "Medium": 4, "Low": 3, "Wishlist": 2, "Unknown": 1, "Undecided": 0}
#: Importances that a level takes in.
IMPORTANCE = {
    "crit": ["Critical"],
    "high+": ["Critical", "High"],
    "med+": ["Critical", "High", "Medium"],
    "low+": ["Critical", "High", "Medium", "Low"],
    "all": ["Critical", "High", "Medium", "Low", "Wishlist", "Unknown", "Undecided"],
}
#: Weight below which a level counts nothing.
BASE_LEVEL = {"crit": 3, "high+": 2, "med+": 1, "low+": 0, "all": -1}
#: Levels and weighting policies of the total score.
LEVELS = ["crit", "high+", "med+", "low+"]
POLICIES = ["flat", "linear", "strong_exp", "weak_exp"]
#: States that a class of states takes in.
STATUS = {
    "committed": ["Fix Committed"],
    "fixed": ["Fix Committed", "Fix Released"],
    "active": ["New", "Confirmed", "Triaged", "In Progress"],
    "all": ["Fix Committed", "Fix Released", "New", "Incomplete", "Opinion", "Invalid", "Won't Fix", "Expired", "Confirmed", "Triaged", "In Progress"],
}
#: Files that are analysed by default.
INCLUDE_SUFFIXES = [".py", ".sh", ".js", ".c", ".go"]
EXCLUDE_PREFIXES = ["tools/"]
#: Beginnings of a line that names bugs which a commit fixes.
BUG_ACCEPT_START = ["closes", "fixes bug", "bug", "lp bug", "partial", "resolves", "backport for bug"]
#: Parts of a line that make its bugs mere mentions.
BUG_REJECT = ["depends on", "related", "http:/", "https://", "/bug"]
#: Parts of other lines that make their bugs fixed ones.
BUG_ACCEPT = ["fix", "* bug", "resolves bug", "refer to bug", "addresses bug"]
BUG_NUMBER = r"bug[s:\s/-]*(?:lp|lp:|lp:#|lp:)*[\s#]*(\d+)"
CHANGE_ID = r"[Cc]hange-[Ii]d:\s*(I[a-f0-9]{40})"
CHERRY_PICK = r"\(cherry picked from commit ([a-f0-9]{40})"
