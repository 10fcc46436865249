"""Row-at-a-time folds over small logs: second oracles, independent of the operators."""


def fold_conditions(reports, removes_running=True):
    """``reports``: (time, type, reason) in order -> list of
    (type, status, reason, last_update, last_transition)."""
    held = []
    for time, kind, reason in reports:
        same = [c for c in held if c[0] == kind]
        if same and same[0][1] == "True" and same[0][2] == reason:
            continue
        since = same[0][4] if same and same[0][1] == "True" else time
        gone = {kind}
        if removes_running and kind == "Reconfiguring":
            gone.add("Running")
        held = [(c[0], "False", *c[2:]) for c in held if c[0] not in gone]
        held.append((kind, "True", reason, time, since))
    return held
