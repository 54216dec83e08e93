"""Text dimensions: wording shown to analysts, looked up by attack class.

The class names and the section keys are fixed values; the sentences are this library's own and may be replaced: every operator that
uses a table takes another as an argument.
"""

ATTACK_NARRATIVE = {
    "Beaconing C2": "Small outgoing messages left this host at regular intervals, as an implant does that asks its operator for orders.",
    "Brute Force": "Sign-ins failed in quick succession, faster than a person types; somebody seems to be guessing a password.",
    "Credential Stuffing": "Many account and password pairs were tried in turn, which points to a list bought or leaked elsewhere.",
    "Data Exfiltration": "Much more data left than this person usually sends, after files were opened that they rarely touch.",
    "Device Spoofing": "The machine claims to be one that this person owns, but its properties do not agree with the record.",
    "Impossible Travel": "Two sign-ins lie so far apart on the map and so close in time that nobody could have made the trip.",
    "Insider Drift": "Over weeks the habits of this account have moved, step by step, to hours and resources it did not use before.",
    "Insider Threat": "Somebody with valid access collects material in bulk, more than the job at hand explains.",
    "Lateral Movement": "From one machine the session went on to several others inside the network, outside this person's usual circle.",
    "Low-and-Slow Exfiltration": "Each transfer is small enough to pass unnoticed; added up over days they are not.",
    "Malware Execution": "Programs and scripts started that do not belong on this machine, in an order known from infections.",
    "Off-hours Access": "The work took place at a time when this person is normally away, and on resources they seldom open.",
    "Privilege Escalation": "The session asked for rights, or used resources, above those that were granted to the account.",
    "Suspicious PowerShell": "The shell ran far more often than usual, in part with arguments that hide what they do.",
    "USB Data Theft": "A large amount of data was written to a drive that can be carried out of the building.",
    "Normal": "Nothing stands out: the session looks like the earlier ones of the same person.",
}

INVESTIGATION_STEPS = {
    "Beaconing C2": [
        "Plot the gaps between outgoing connections and look for a fixed rhythm",
        "List the names that the host resolved and when each was first registered",
        "Match destinations with the current list of hostile addresses",
        "Look for unknown services and start-up entries on the host",
        "Cut the host off and keep an image of its disk and memory",
    ],
    "Brute Force": [
        "Count failures by source address and hour",
        "See whether a success follows the failures",
        "Hold the account and refuse the source address",
        "Make sure that a second factor is asked for",
        "Ask whether the password is used elsewhere",
    ],
    "Credential Stuffing": [
        "Count the accounts that each source tried",
        "See whether sources belong to anonymous relays",
        "Slow down or challenge sign-ins at the affected entrance",
        "List accounts that let the caller in",
        "Have their owners choose new passwords",
    ],
    "Data Exfiltration": [
        "Add up what left the network in this session, by destination",
        "Look at mail and cloud uploads of the same hour",
        "Ask the manager whether the transfer was part of a task",
        "Compare the destinations with those of colleagues",
        "Keep copies of the files and of the traffic record",
    ],
    "Device Spoofing": [
        "Hold the reported device properties against the inventory",
        "Find out where the real device was",
        "Look for devices enrolled recently for this account",
        "Look for other oddities of the session, such as new addresses",
        "Withdraw trust in the device and ask for a fresh sign-in",
    ],
    "Impossible Travel": [
        "Work out distance and time between the two places",
        "See whether a tunnel or relay explains one of them",
        "Call the person and ask about both sessions",
        "Ask whether somebody else knows the password",
        "Hold the account until that is answered",
    ],
    "Insider Drift": [
        "Draw the account's habits over the last quarter",
        "Put them next to those of the team",
        "Ask the manager about new duties",
        "Check for moves or reorganisations at that time",
        "Watch the account more closely if nothing explains the change",
    ],
    "Insider Threat": [
        "List what was opened, copied and downloaded",
        "Look for archives built on local or shared storage",
        "Ask personnel about notice given or conflicts",
        "Secure the records so that they stand up later",
        "Bring in those who handle insider cases",
    ],
    "Lateral Movement": [
        "Draw the path from machine to machine",
        "Mark the machines this person never used",
        "Read the remote sign-in records of each",
        "See whether an administrator's account was used",
        "Close off the machines reached and look for more",
    ],
    "Low-and-Slow Exfiltration": [
        "Add up outgoing data by day over the last month",
        "Look for the same folders being read again and again",
        "Look for timed jobs that send data",
        "Hold the account against earlier insider findings",
        "Set a limit on the sum, not only on single transfers",
    ],
    "Malware Execution": [
        "Draw the tree of processes and note each parent",
        "Run unknown programs where they can do no harm",
        "Decode the arguments of scripts that ran",
        "Take the machine off the network",
        "Scan it fully before it returns",
    ],
    "Off-hours Access": [
        "Look for a duty roster or a permit for that hour",
        "List what was opened",
        "Ask the person or whoever was on duty",
        "Check place and device of the session",
        "Look for other findings in the same night",
    ],
    "Privilege Escalation": [
        "List the rights used and who granted them",
        "Compare group memberships with those of last week",
        "Read the elevation records of the machines involved",
        "Look for a flaw or wrong setting that was used",
        "Take back every right that nobody granted",
    ],
    "Suspicious PowerShell": [
        "Collect all commands of the session",
        "Decode what was passed in encoded form",
        "Look for code fetched from outside",
        "Look for tasks and keys that survive a restart",
        "Turn on full script records if they were off",
    ],
    "USB Data Theft": [
        "Find the drive's serial number in the inventory",
        "List the files that were written to it",
        "Get hold of the drive",
        "Ask the person what it was for",
        "Restrict drives on machines of this kind",
    ],
    "Normal": [
        "Nothing to do: the session fits its baseline.",
    ],
}

BUSINESS_IMPACT = {
    "Normal": "None expected.",
    "Beaconing C2": "Someone outside can steer this host. They may read what it can read and go on from there.",
    "Brute Force": "If a guess succeeds, the account and all it opens are in other hands.",
    "Credential Stuffing": "Several accounts may open at once, of staff or of customers.",
    "Data Exfiltration": "Confidential data may be gone for good, and the loss may have to be reported.",
    "Device Spoofing": "Rules that trust known devices do not hold for this caller.",
    "Impossible Travel": "Somebody else probably knows the password and acts in this person's name.",
    "Insider Drift": "A slow change can end in leaks or damage; today the loss is small.",
    "Insider Threat": "Designs, prices or customer records may leave with somebody who knows their worth.",
    "Lateral Movement": "Every further machine raises the cost of cleaning up; an early stop keeps it low.",
    "Low-and-Slow Exfiltration": "The loss so far may be large although no single day shows it.",
    "Malware Execution": "The infection may spread and make files or machines unusable.",
    "Off-hours Access": "Probably small, unless the account is in other hands.",
    "Privilege Escalation": "With such rights a caller can change or read nearly anything.",
    "Suspicious PowerShell": "The shell may have planted something that returns after a restart.",
    "USB Data Theft": "Data on a drive passes every network control and cannot be called back.",
}
NO_IMPACT = "Not known for this class."

#: Actions and sentences that are put together by severity and by what is known of a case.
ACTION = {
    "isolate": "Take the host off the network at once",
    "page": "Wake the people who decide in an emergency",
    "inform": "Tell the security manager on duty",
    "hunt": "Search neighbouring hosts for the same traces, around the clock",
    "audit": "Go through all directory rights of the account",
    "none": "Nothing to contain; keep watching.",
    "script": "End running shells and scripts on the host.",
    "outgoing": "Stop outgoing transfers of the host and cut it off.",
    "sign_in": "End all sign-ins of the account and withdraw its password.",
    "admin": "Suspend administrator rights of the account and end its administrator sessions.",
    "look": "Cut the host off and look at it.",
    "campaign_isolate": "Cut all hosts of the campaign off from the inner network.",
    "campaign_protocols": "Stop file sharing and remote desktops between them.",
    "campaign_hosts": ("Cut off these hosts: ", "."),
    "campaign_addresses": ("Refuse these addresses at the border: ", "."),
    "campaign_accounts": ("Hold these accounts and end their sessions: ", "."),
    "campaign_report": "Keep one common record and follow the response plan.",
}

#: What to do by stage of response where a site has no playbooks of its own: containment and recovery by kind of case, the rest from the steps above.
_HOST = (["Cut the host off and keep it running for the examination"], ["Reinstall the host from a clean image", "Return it after a scan and watch it for two weeks"])
_ACCOUNT = (["End the account's sessions", "Hold the account until its owner is reached"], ["Give new credentials and a second factor", "Watch the next sign-ins"])
_DATA = (["Stop the transfer and block its destination or drive", "Keep the files and records as they are"], ["Settle who must be told of the loss", "Limit access to the data to those who need it"])
_NONE = (["No containment needed"], ["No recovery needed"])
PLAYBOOK_KIND = {
    "Beaconing C2": _HOST, "Malware Execution": _HOST, "Suspicious PowerShell": _HOST, "Lateral Movement": _HOST, "Device Spoofing": _HOST,
    "Brute Force": _ACCOUNT, "Credential Stuffing": _ACCOUNT, "Impossible Travel": _ACCOUNT, "Off-hours Access": _ACCOUNT, "Privilege Escalation": _ACCOUNT, "Insider Drift": _ACCOUNT,
    "Data Exfiltration": _DATA, "Low-and-Slow Exfiltration": _DATA, "USB Data Theft": _DATA, "Insider Threat": _DATA, "Normal": _NONE,
}
