"""Syslog facilities by name."""

from __future__ import annotations

from logging.handlers import SysLogHandler

#: The names that are accepted.  Those that the system has no number for count as local2.
FACILITIES = (
    "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp log_audit log_alert "
    "local0 local1 local2 local3 local4 local5 local6 local7"
).split()
AS_LOCAL2 = ("ntp", "log_audit", "log_alert")


def facility_number(name: str) -> int | None:
    """The number of a facility, whatever the case of its name; None if there is none."""
    name = name.lower()
    if name not in FACILITIES:
        return None
    return SysLogHandler.facility_names["local2" if name in AS_LOCAL2 else name]
