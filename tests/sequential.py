"""One change request at a time: the plain form of the fold's rules, for tests."""


def step(state, action, is_admin, reason):
    """(new state, accepted, new value) of a request against (void, payment, status)."""
    void, pay, status = state
    blank = reason is None or reason.strip() == ""
    if action in ("VOID", "REVERT_VOID"):
        if not is_admin or (action == "VOID" and (blank or void == "Voided")) \
                or (action == "REVERT_VOID" and void == "Active"):
            return state, False, None
        new = "Voided" if action == "VOID" else "Active"
        return (new, pay, status), True, new
    if status == "Claimed" or void == "Voided":
        return state, False, None
    if action == "PAY":
        if not is_admin and pay == "Paid":
            return state, False, None
        new = ("Unpaid" if pay == "Paid" else "Paid") if is_admin else "Paid"
        return (void, new, status), True, new
    if pay != "Paid" or action == status:
        return state, False, None
    return (void, pay, action), True, action
