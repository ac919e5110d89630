"""Declared schemas of the records; nothing is inferred."""

PERSON = "struct<_account_id:int,name:string>"
VOTE = "struct<_account_id:int,name:string,value:int>"
LABEL = f"struct<all:array<{VOTE}>,approved:{PERSON},recommended:{PERSON},value:int>"
COMMITS = "cid string, author string, committer string, date bigint, msg string, parents array<string>, unfiltered_files array<string>, files array<string>, bugs array<string>, change_id string, on_master_branch boolean"
BUGS = "id string, title string, description string, importance string, status string, heat int, security_related boolean, cves array<string>, messages array<struct<content:string,date_created:string>>"
CHANGES = "change_id string, _number int, project string, branch string, status string, _sortkey string"
DETAILS = f"{CHANGES}, owner {PERSON}, labels map<string,{LABEL}>, messages array<struct<_revision_number:int,message:string>>"
ENTRIES = "cid string, diff_commit string, blame_commit string, kind string, bug_id string"
BLAME = "diff_commit string, blame_commit string, path string, lineno int, proximity int, commit string"
PREDICTIONS = "clf string, iter int, row_id bigint, y int, p0 double, p1 double"
