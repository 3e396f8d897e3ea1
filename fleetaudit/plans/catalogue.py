"""Texts of the checks. Check ids, names and importance are fixed values; the sentences are our own.

Families whose entries differ in one word only are built from their list.
"""
from __future__ import annotations

from ..operators import Rule
from .discovery import NAMES

_RECOVERABILITY = [
    Rule(201, 1, "Split backup chain", "{object} backups of {database} lie in {metric} locations", "Keep the backups of one database in one place."),
    Rule(202, 2, "Backups without checksum", "{metric} backup files of {database} were written without a checksum", "Write backups with a checksum."),
    Rule(203, 1, "Missing full backup", "{database} has no full backup", "Take a full backup."),
    Rule(204, 1, "Missing log backup", "{database} has no log backup although its log is kept", "Schedule log backups or switch the recovery model."),
    Rule(205, 1, "No recent full backup", "{database} has no full backup of the last 7 days", "Check the schedule of full backups."),
    Rule(206, 1, "No recent log backup", "{database} has no log backup of the last 24 hours", "Check the schedule of log backups."),
    Rule(207, 1, "Failed database backups", "A backup of {database} failed", "Read the log around the failure."),
    Rule(208, 2, "Backup compression", "{object} is off", "Turn compression on unless the data does not compress."),
    Rule(209, 2, "Backup checksum", "{object} is off", "Turn the checksum default on."),
    Rule(210, 1, "Database backup certificate never been backed up.", "{object}, which protects backups of {database}, was never saved", "Save the certificate with its key elsewhere."),
    Rule(210, 1, "Database backup certificate not backed up recently.", "{object}, which protects backups of {database}, was last saved over 90 days ago", "Save the certificate with its key again.", 1),
    Rule(211, 1, "TDE certificate not backed up recently", "{object}, which encrypts {database}, was never saved", "Save the certificate with its key elsewhere."),
    Rule(211, 1, "TDE certificate not backed up recently", "{object}, which encrypts {database}, was last saved over 90 days ago", "Save the certificate with its key again.", 1),
    Rule(212, 1, "Database backup certificate set to expire.", "{object}, which protects backups of {database}, expires in {metric} days", "Plan a new certificate."),
    Rule(213, 2, "TDE certificate set to expire", "{object}, which encrypts {database}, expires in {metric} days", "Plan a new certificate."),
    Rule(214, 1, "Missed RPO", "{database} was last backed up {metric} minutes ago, past its objective", "Back up more often or change the objective."),
    Rule(214, 1, "Missed RPO", "{database} has an objective but no backup", "Schedule backups.", 1),
    Rule(215, 2, "Password protected backups", "Recent backups of {database} need a password", "Store the password where operators find it."),
    Rule(216, 2, "Backup history not purged", "The history goes back to {object}", "Purge old history on a schedule."),
    Rule(217, 2, "High VLF count", "The log of {database} has {metric} fragments", "Shrink the log and grow it in few steps."),
    Rule(218, 1, "Log backup to NUL", "{metric} log backups of {database} went nowhere, last {object}", "Stop the job that discards the log."),
]

_SECURITY = [
    Rule(301, 1, "sysadmin role members", "{object} holds the sysadmin role", "Confirm the login needs it."),
    Rule(302, 1, "securityadmin role members", "{object} holds the securityadmin role", "Confirm the login needs it."),
    Rule(303, 1, "CONTROL SERVER permissions", "{object} may do anything on the server", "Confirm the login needs it."),
    Rule(304, 3, "Invalid login with Windows Authentication", "{object} is unknown to the directory", "Drop the login."),
    Rule(305, 2, "Database Owner is Unknown", "No login matches the owner of {database}", "Set a valid owner."),
    Rule(306, 3, "Database owner discrepancy", "{database} knows another owner than {object}", "Set the owner again."),
    Rule(307, 1, "Enabled sa account", "{object} is enabled", "Disable the built-in administrator."),
    Rule(308, 1, "TRUSTWORTHY database owned by sysadmin", "{database} is trusted and owned by {object}, a sysadmin", "Turn the flag off or change the owner."),
    Rule(309, 2, "Configuration: clr enabled", "{object} is on", "Turn it off where no assembly needs it."),
    Rule(309, 2, "Configuration: clr enabled", "{object} is on", "Prefer strict security of assemblies.", 1),
    Rule(312, 2, "Encrypted databases", "{metric} databases use {object}", "Keep their keys safe."),
    Rule(312, 2, "Encrypted databases", "{metric} databases are not encrypted", "Decide whether they should be.", 1),
    Rule(313, 2, "Stored procedure run at Startup", "{object} runs at startup", "Confirm what it does."),
    Rule(314, 2, "SQL Agent job run at Startup", "Job {object} runs at startup", "Confirm what it does."),
    Rule(315, 1, "local Administrators", "The {object} administers the host", "Confirm the account needs it."),
    Rule(316, 1, "Password blank", "{object} has no password", "Set a strong password."),
    Rule(317, 1, "Password is same as login", "The password of {object} is its name", "Set a strong password."),
    Rule(318, 1, "Password is password", "The password of {object} is the word itself", "Set a strong password."),
    Rule(323, 1, "Linked Server configured with sa", "{object} signs in as the administrator", "Use a login with few rights."),
    Rule(324, 2, "Linked Server configured with fixed login", "{object} signs in with one login for all", "Map logins one by one."),
    Rule(325, 2, "Linked Server", "{object} uses the caller's own context", "Confirm the link is needed."),
    Rule(325, 2, "Linked Server", "{object} denies unmapped logins", "Confirm the link is needed.", 1),
    Rule(325, 2, "Linked Server", "{object} maps a login to a remote one", "Confirm the mapping is needed.", 2),
    Rule(325, 2, "Linked Server", "{object} passes a login's own credentials", "Confirm the mapping is needed.", 3),
    Rule(326, 2, "SQL Server Audit running", "Audit {object} runs", "Confirm it records what it should."),
    Rule(327, 2, "Database owner is not preferred", "{database} is owned by {object}", "Set the preferred owner."),
    Rule(328, 2, "Database owner is a sysadmin", "{database} is owned by {object}, a sysadmin", "Use an owner with few rights."),
    Rule(329, 1, "Service using built-in elevated account", "The engine runs as {object}", "Use a plain service account."),
    Rule(329, 1, "Service using built-in elevated account", "The Agent runs as {object}", "Use a plain service account.", 1),
    Rule(330, 1, "No audit of failed logins", "Failed logins are not recorded", "Record failed logins."),
    Rule(331, 1, "Failed logins", "The log holds {metric} failed logins", "Find where they come from."),
    Rule(332, 2, "TRUSTWORTHY database", "{database} is trusted", "Turn the flag off where not needed."),
    Rule(333, 2, "db_owner role member", "{object} of {database}", "Confirm the user needs it."),
    Rule(334, 1, "db_owner role member - system databases", "{object} of {database}", "Remove the user from the role."),
    Rule(335, 2, "Unusual database permissions", "{object} of {database}", "Confirm the user needs it."),
    Rule(336, 1, "Unusual database permissions - system databases", "{object} of {database}", "Remove the user from the role."),
    Rule(337, 3, "Roles within roles", "{object} of {database}", "Grant what the role needs directly."),
    Rule(338, 3, "Orphaned database user", "{object} of {database} has no login", "Map or drop the user."),
    Rule(339, 2, "Public permissions", "Everyone may {object} in {database}", "Grant it to those who need it."),
    Rule(340, 2, "Renamed sa account", "The built-in administrator is called {object}", "Confirm that tools cope with the name."),
    Rule(344, 2, "contained database", "{database} authenticates its own users", "Review its users."),
    Rule(346, 2, "Database owned by Windows account", "{database} is owned by {object}", "Use an owner that does not leave."),
    Rule(350, 2, "Service account in sysadmin", "The engine's account {object} is a sysadmin", "Take the role away."),
    Rule(350, 2, "Service account in sysadmin", "The Agent's account {object} is a sysadmin", "Take the role away.", 1),
    Rule(351, 1, "Service account in local Administrators", "The engine's account {object} administers the host", "Take it out of the group."),
    Rule(351, 1, "Service account in local Administrators", "The Agent's account {object} administers the host", "Take it out of the group.", 1),
    Rule(352, 2, "SQL Agent proxy account in sysadmin", "Proxy {object} is a sysadmin", "Use an account with few rights."),
    Rule(353, 1, "xp_cmdshell proxy account exists", "Commands of the host run as {object}", "Drop the credential unless needed."),
    Rule(354, 1, "IMPERSONATE ANY LOGIN permissions", "{object} may act as any login", "Confirm the login needs it."),
    Rule(355, 2, "ALTER ANY LOGIN permissions", "{object} may change any login", "Confirm the login needs it."),
    Rule(356, 3, "tempdb encrypted", "tempdb is encrypted, as some database is", "Expect the cost."),
]
_SECURITY += [Rule(i, 2, f"Configuration: {name}", f"{name} is on", "Turn it off unless needed.") for i, name in (
    (319, "xp_cmdshell"), (320, "Ole Automation Procedures"), (321, "Cross-database ownership chaining"), (322, "Ad Hoc Distributed Queries"))]
_SECURITY += [Rule(i, 2, f"Configuration: {name}", f"{name} is {{object}}", "Confirm the state is wanted.") for i, name in (
    (310, "Remote admin connection"), (311, "Database Mail XPs"), (341, "C2 audit mode"), (342, "Common Criteria Compliance"),
    (343, "Contained Database Authentication"), (345, "Remote Access"))]
_SECURITY += [Rule(i, 2, f"Configuration Manager: {name}", f"{name} is {{object}}", "Confirm the state is wanted.") for i, name in (
    (347, "Hide Instance"), (348, "Extended Protection"), (349, "Force Encryption"))]

_AVAILABILITY = [
    Rule(401, 1, "Database in single user mode", "{database} admits one user", "Open it again."),
    Rule(402, 1, "Database in restricted user mode", "{database} admits few users", "Open it again."),
    Rule(403, 2, "Database in read-only mode", "{database} is read-only", "Confirm it should be."),
    Rule(404, 2, "Database offline", "{database} is offline", "Confirm it should be."),
    Rule(405, 1, "Database suspect", "{database} cannot be opened safely", "Check it and restore it if needed."),
    Rule(406, 1, "Endpoint owner", "Endpoint and owner: {object}", "Give it an owner that stays."),
    Rule(407, 1, "Availability Group owner", "Group and owner: {object}", "Give it an owner that stays."),
    Rule(408, 1, "Less than 3 quorum members online", "{object} has {metric} voting members up", "Bring members back or add a witness."),
    Rule(409, 1, "Less than 3 quorum votes among members", "{object} has {metric} votes", "Add votes."),
    Rule(410, 1, "Offline cluster member", "{object} is not up", "Bring it back."),
    Rule(411, 1, "Endpoint not started", "{object} is not started", "Start it."),
    Rule(412, 2, "Seeding mode different among members", "Replicas of {object} seed in different ways", "Use one mode."),
    Rule(413, 1, "Replica database not joined", "{database} has not joined {object}", "Join it."),
    Rule(414, 1, "Data movement suspended", "{database} receives nothing in {object}", "Resume it."),
    Rule(415, 2, "Session timeout too low", "{object} waits the default 10 seconds", "Raise the timeout."),
    Rule(415, 2, "Session timeout too low", "{object} waits {metric} seconds only", "Raise the timeout.", 1),
    Rule(416, 2, "Backup preference not Primary", "Group and preference: {object}", "Confirm where backups run."),
    Rule(417, 1, "Listener offline", "No address answers: {object}", "Bring the listener online."),
    Rule(418, 2, "Seeding mode set to AUTOMATIC", "{object} seeds by itself", "Confirm the network can bear it."),
    Rule(419, 3, "Trace flag 9567 enabled", "Seeding is compressed", "Turn the flag off after seeding."),
    Rule(420, 2, "Endpoint using expiring certificate", "Expiring: {object}", "Plan a new certificate."),
    Rule(421, 1, "Replica is not failover ready", "{database} is not ready on {object}", "Find out why it lags."),
    Rule(422, 2, "High HADR_SYNC_COMMIT waits", "A commit waits {metric} ms", "Check secondaries and network."),
    Rule(423, 2, "High secondary lag", "{database} lags {metric} s on {object}", "Check secondaries and network."),
    Rule(424, 2, "Health Check Timeout too low", "{object} uses the default timeout", "Raise the timeout."),
    Rule(424, 2, "Health Check Timeout too low", "{object} waits {metric} ms only", "Raise the timeout.", 1),
    Rule(425, 3, "Trace flag 1800 enabled", "Log writes are aligned for mixed disks", "Confirm the disks need it."),
    Rule(426, 2, "Recent state change", "{object} changed state in the last day", "Look for an unplanned failover."),
    Rule(427, 2, "Different failover modes - same AG", "Replicas of {object} fail over in different ways", "Confirm the modes."),
    Rule(428, 2, "Different failover modes - same instance", "Groups on {object} fail over in different ways", "Confirm the modes."),
    Rule(429, 1, "AlwaysOn_health XE stopped", "{object} does not run", "Start the session."),
    Rule(430, 1, "Synchronous replica not synchronized", "{database} is behind on {object}", "Find out why."),
    Rule(431, 1, "Replica disconnected", "{object} is disconnected", "Check network and service."),
    Rule(432, 1, "SQL Server Service endpoint permission", "The service account cannot connect to the endpoint", "Grant it."),
]

_INTEGRITY = [
    Rule(501, 1, "Page verification not set to CHECKSUM", "{database} verifies pages by {object}", "Use checksums."),
    Rule(502, 1, "Alert missing", "No alert for {object}", "Create the alert."),
    Rule(503, 1, "Missing integrity checks", "{database} was last checked on {object}", "Check it every week."),
    Rule(504, 1, "Suspect pages detected", "{database}: {metric}; {object}", "Check the database and its storage."),
    Rule(505, 2, "Disabled alerts", "{object} is disabled", "Enable or drop the alert."),
    Rule(506, 2, "Automatic page repair activity", "{metric} pages of {database} were repaired, last {object}", "Check the storage."),
]

_RELIABILITY = [
    Rule(601, 1, "*Security update available", "Version {object} at build {metric} lacks a security update", "Apply the update."),
    Rule(602, 1, "*Unsupported version of SQL Server", "Version {object} is out of support", "Upgrade."),
    Rule(603, 3, "Instance online over 180 days", "Last started {object}", "Plan updates."),
    Rule(604, 1, "tempdb files on the C drive", "{object} lies on drive C", "Move it."),
    Rule(605, 2, "tempdb file with no growth allowed", "{object} cannot grow", "Allow growth."),
    Rule(606, 1, "User database file on the C drive", "{object} of {database} lies on drive C", "Move it."),
    Rule(607, 2, "User database file with no growth allowed", "{object} of {database} cannot grow", "Allow growth."),
    Rule(608, 2, "User database log and data files are on the same drive", "{database} keeps log and data together", "Split them."),
    Rule(609, 2, "SQL Agent job schedule is disabled", "Job and schedule: {object}", "Enable the schedule or drop the job."),
    Rule(610, 2, "SQL Agent job is enabled without a schedule", "{object} never runs by itself", "Add a schedule or disable the job."),
    Rule(611, 2, "SQL Agent jobs owned by users", "Job and owner: {object}", "Give it an owner that stays."),
    Rule(612, 2, "Default data file path is on the C drive", "New data goes to {object}", "Change the path."),
    Rule(613, 2, "Default log file path is on the C drive", "New logs go to {object}", "Change the path."),
    Rule(614, 2, "Default backup file path is on the C drive", "Backups go to {object}", "Change the path."),
    Rule(615, 2, "Min and max memory settings", "Both limits are {metric} MB", "Set a range."),
    Rule(616, 2, "Max memory setting", "{object} has no limit", "Set a limit."),
    Rule(617, 2, "Server name discrepancy", "Names: {object}", "Register the new name."),
    Rule(618, 1, "Low drive space", "Drive {object} is {metric} percent full", "Free or add space."),
    Rule(619, 1, "tempdb file with max size set", "{object} stops at {metric} MB", "Lift the limit."),
    Rule(620, 2, "Database file with max size set", "{object} of {database} stops at {metric} MB", "Lift the limit."),
    Rule(621, 1, "Evaluation Edition", "The instance stops on {object}", "License or move it."),
    Rule(622, 2, "Number of error logs", "{metric} error logs are kept", "Keep more."),
    *[Rule(623, 2, f"Replication enabled: {role}", f"{{database}} takes part in replication: {role}", "Confirm it is needed.", i)
      for i, role in enumerate(("publisher", "subscriber", "merge replication", "distribution"))],
    Rule(624, 1, "Low available physical memory", "{metric} MB are free", "Find what uses the memory."),
    Rule(625, 2, "Database Snapshot found", "{database} is a snapshot of {object}", "Drop old snapshots."),
    Rule(626, 2, "Pending configuration change", "Running and configured: {object}", "Apply or revert the change."),
    Rule(627, 2, "Unusual database state", "{database} is {object}", "Find out why."),
    Rule(628, 1, "SQL Server Agent offline", "{object}", "Start the service."),
    Rule(629, 1, "Recent memory dumps", "{metric} dumps, last {object}", "Read the log around the dumps."),
    Rule(630, 1, "User database with logical file named master", "{object} of {database}", "Rename the file."),
    Rule(631, 1, "Priority Boost enabled", "{object} is on", "Turn it off."),
    Rule(632, 1, "System database below installed compatibility level", "{database} is at level {metric}", "Raise the level."),
]

_PERFORMANCE = [
    Rule(701, 2, "Cost threshold for parallelism", "{object} is at its default", "Raise it."),
    Rule(702, 2, "Max degree of parallelism", "{object} is unlimited", "Set a limit by core count."),
    Rule(702, 2, "Max degree of parallelism", "{object} is 1, so nothing runs in parallel", "Raise it unless the vendor asks for it.", 1),
    Rule(705, 2, "Lower compatibility level", "{database} is at level {metric}", "Raise the level after a test."),
    Rule(706, 2, "Trace Flag not enabled", "{object} is off", "Consider the flag."),
    Rule(707, 1, "Number of tempdb data files not recommended", "{metric} data files for {object}", "One a core, eight at most."),
    Rule(708, 1, "Unequally sized tempdb data files", "Data files differ in size", "Make them equal."),
    Rule(709, 1, "Uneven tempdb growth rates", "Data files grow by different steps", "Make them equal."),
    Rule(710, 2, "tempdb log file larger than data files", "The log exceeds the data", "Look for long transactions."),
    Rule(711, 1, "tempdb file with percentage growth rates", "{object} grows by percent", "Use a fixed step."),
    Rule(712, 1, "tempdb file with growth rates less than 64 MB", "{object} grows by {metric} pages", "Use a larger step."),
    Rule(713, 1, "Multiple log files", "{metric} log files", "Keep one."),
    Rule(714, 1, "tempdb file with high usage", "{object} is nearly full", "Add space or find the user."),
    *[Rule(i, 2, f"Trace Flag {flag}", f"{flag} is off", "Turn it on for this version.") for i, flag in ((715, 1117), (716, 1118))],
    Rule(717, 2, "Memory-optimized tempdb metadata", "{object} is on", "Confirm the memory suffices."),
    *[Rule(i, 1, f"Slow {what}", f"{{object}} needs {{metric}} ms for {what}", "Check the storage.") for i, what in ((718, "reads"), (719, "writes"))],
    Rule(720, 2, "Database log file larger than data files", "The log of {database} has {metric} pages", "Check log backups."),
    Rule(721, 1, "Database file with percentage growth rates", "{object} of {database} grows by percent", "Use a fixed step."),
    Rule(722, 1, "Database file with growth rates less than 64 MB", "{object} of {database} grows by {metric} pages", "Use a larger step."),
    Rule(723, 1, "Multiple log files", "{database} has {metric} log files", "Keep one."),
    Rule(724, 1, "Power plan not optimal", "The host runs on {object}", "Use high performance."),
    Rule(725, 1, "Instant file initialization", "New files are zeroed first", "Grant the right to the service."),
    Rule(726, 2, "Lock pages in memory", "{object} are locked", "Confirm the memory limit."),
    Rule(727, 2, "Resource Governor limits used for tempdb", "{object}: {metric} MB", "Confirm the limit."),
    Rule(727, 2, "Resource Governor limits used for tempdb", "{object}: {metric} percent", "Confirm the limit.", 1),
    Rule(729, 1, "Offline CPU schedulers", "{metric} schedulers of {object} are off", "Check licensing and affinity."),
    Rule(730, 1, "More than 16 tempdb data files", "{metric} data files", "Use fewer."),
    Rule(731, 2, "Resource Governor enabled", "Resource Governor is on", "Confirm its limits."),
    Rule(732, 2, "Enabled server-level triggers", "{object} runs on the server", "Confirm what it does."),
    Rule(738, 2, "Custom Extended Events running", "{object} runs", "Stop it when done."),
    Rule(739, 2, "I/O freeze detected", "{database}: {object}, {metric} ms on average", "Check snapshot backups of the host."),
    Rule(741, 2, "Accelerated Database Recovery", "It is on for {database}", "Watch the version store."),
    Rule(742, 2, "Locked Pages In Memory with max memory at default", "{object} are locked without a limit", "Set a limit."),
]
_PERFORMANCE += [Rule(i, 2, f"{name} {state}", f"{name} is {state} for {{database}}", "Confirm the setting.") for i, name, state in (
    (703, "Auto shrink", "enabled"), (704, "Auto close", "enabled"), (728, "Auto create statistics is", "disabled"), (733, "Change Tracking", "enabled"),
    (734, "Recursive triggers", "enabled"), (735, "Forced parameterization", "enabled"), (736, "Change Data Capture", "enabled"),
    (737, "Delayed durability", "enabled"), (740, "Auto update statistics is", "disabled"))]

_DISCOVERY = [Rule(i, 0, name, f"{name}: {{object}}", "") for i, name in NAMES.items()]

BASE = [*_DISCOVERY, *_RECOVERABILITY, *_SECURITY, *_AVAILABILITY, *_INTEGRITY, *_RELIABILITY, *_PERFORMANCE]

# Where a profile weighs or files a check differently: (check, case) to (importance, category).
OVERRIDES = {
    "health": {(305, 0): (3, 2)},
    "security": {(210, 1): (2, None), (212, 0): (2, None)},
}


def rules_for(profile: str) -> list[Rule]:
    """Rules with the profile's own importance and category."""
    out = []
    for r in BASE:
        importance, category = OVERRIDES.get(profile, {}).get((r.check_id, r.case_no), (r.importance, r.category))
        out.append(Rule(r.check_id, importance, r.name, r.issue, r.action, r.case_no, category))
    return out

