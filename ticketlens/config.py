"""Header aliases, phrases, categories, stop words and limits.

The lists below are fixed values of the ticket domain; results depend on each of them.
"""

from __future__ import annotations

#: Canonical column -> headers that carry it; the first one present wins.
SOURCE_COLUMNS = {
    "number": ("Number", "number"),
    "task_type": ("Task type", "sys_class_name"),
    "priority": ("Priority", "priority"),
    "state": ("State", "state"),
    "short_description": ("Short description", "short_description"),
    "description": ("Description", "description"),
    "work_notes": ("Work notes", "work_notes"),
    "assignment_group": ("Assignment group", "assignment_group"),
    "assigned_to": ("Assigned to", "assigned_to"),
    "opened": ("Opened", "opened_at"),
    "closed": ("Closed", "closed_at"),
    "channel": ("Channel", "contact_type"),
    "made_sla": ("Made SLA", "made_sla"),
}
DIMENSION_COLUMNS = {
    "service": ("Service", "business_service"),
    "service_offering": ("Service offering", "service_offering"),
    "resolution_code": ("Resolution code",),
}
EXPORT_EXCLUDED = ("opened_by", "closed_by", "sys_updated_by")

SYSTEM_AUTHORS = ("system",)
SYSTEM_PHRASES = (
    "sent communication to", "could not contact", "task is created by system", "escalation is in progress",
    "escalate in", "faq on alerts", "predicted ag:", "attachment added", "why was this incident created",
    "how is the priority", "confidence:",
)
AUTO_DESCRIPTION_PHRASES = (
    "we have identified unusually", "alert triggered at", "usage overview", "cluster name", "namespace :",
    "container name:", "pod name:", "document count:", "conditions met:", "links for investigation",
)

#: Ordered: the first category whose words match wins. Words are matched at ASCII word boundaries.
CATEGORIES = (
    ("Account & Access", r"password|passwd|contraseña|account lock|locked out|lockout|unlock|reset.{0,12}password|mfa|multi.?factor|2fa|authenticat|credential|sso|single sign|permission|access request|grant access|no access|denied access|acceso|bloqueo de cuenta"),
    ("VPN & Remote Access", r"vpn|remote access|anyconnect|globalprotect|forticlient|remote desktop|rdp|citrix|terminal server|escritorio remoto"),
    ("Email & Collaboration", r"outlook|exchange|mailbox|buzon|buzón|correo|email|e-mail|smtp|distribution list|calendar|teams|sharepoint|onedrive|zoom|slack"),
    ("Network & Connectivity", r"network|wifi|wi-fi|wireless|ethernet|lan|wan|switch|router|firewall|dns|dhcp|ip address|latency|packet loss|no internet|sin internet|conectividad|connectivity|disconnect"),
    ("Hardware & Devices", r"laptop|desktop|monitor|keyboard|mouse|docking|dock station|battery|screen|hard drive|ssd|ram|motherboard|headset|webcam|scanner|hardware|dispatch|equipo|teclado|pantalla"),
    ("Printing", r"print|printer|printing|spooler|toner|cartridge|impresora|imprimir|scan to"),
    ("Performance & Availability", r"slow|slowness|performance|latency|hang|hanging|freez|frozen|crash|crashing|unresponsive|timeout|timed out|outage|down|unavailable|degraded|lento|caido|caído|no responde"),
    ("Storage & Capacity", r"disk (space|full)|storage|capacity|quota|out of space|no space|espacio en disco|file share|shared drive|nas|san"),
    ("Certificates & Expiry", r"certificate|cert expir|ssl|tls|expired|expiry|renewal|licence|license expir|certificado|caducad"),
    ("Database", r"database|sql|oracle|postgres|mysql|mongo|query|deadlock|replication|base de datos"),
    ("Backup & Recovery", r"backup|restore|recovery|snapshot|veeam|respaldo|recuperaci"),
    ("Monitoring Alerts", r"alert triggered|monitoring|threshold|cluster name|namespace|pod name|container name|document count|conditions met|cpu usage|memory usage|elasticsearch|grafana|datadog|splunk"),
    ("Software & Applications", r"install|installation|upgrade|update|patch|version|licen[cs]e|application|software|erp|sap|salesforce|browser|chrome|edge|firefox|excel|word|instalaci|aplicaci"),
    ("Security", r"phishing|malware|virus|ransomware|spam|suspicious|breach|vulnerab|antivirus|threat|seguridad"),
)
UNCATEGORIZED = "Other / Uncategorised"

ROOT_CAUSE_PHRASES = (
    "root cause", "root-cause", "because", "caused by", "the reason", "identified that", "found that", "the issue was",
    "the problem was", "diagnosis", "traced to", "due to", "investigation", "it was determined", "underlying",
    "causa raiz", "causa raíz", "porque", "la razón", "se identificó", "se encontró", "causado por", "el problema era",
    "diagnóstico", "se debe a",
)
STEP_PHRASES = (
    "step", "performed", "applied", "executed", "restarted", "reconfigured", "updated", "corrected", "fixed",
    "implemented", "restored", "created", "modified", "enabled", "disabled", "solution", "resolved", "workaround",
    "tested", "verified", "confirmed", "action taken", "resolution", "the fix", "se realizó", "se aplicó", "se ejecutó",
    "se reinició", "se actualizó", "se corrigió", "se arregló", "se implementó", "solución", "resuelto", "se verificó",
    "se confirmó", "acción tomada",
)

#: Words that say nothing about which problem a ticket describes.
STOP_WORDS = tuple(dict.fromkeys((
    "the and for are but not you all can her was one our out day get has him his how its new now old see two way who "
    "boy did she use their will with this that from they been have more when some them than then were what your about "
    "there would could should please thanks thank hello team hi dear regards kindly need needs needed want wants help "
    "assist assistance support issue issues problem problems incident ticket request case user users customer employee "
    "staff client end unable cannot cant doesnt does not working work works reported reports report reporting says said "
    "getting gets received receive receiving seeing sees having via due after before during while because since "
    "que con por para los las del una uno como esta este esto esa ese son sus pero mas muy todo toda usuario usuarios "
    "favor gracias hola equipo ayuda apoyo problema problemas incidente solicitud puede puedo tiene presenta reporta "
    "reporte indica menciona"
).split()))

DIMS = ("description_quality", "root_cause", "steps_documented", "spelling_grammar", "professionalism")
WEIGHTS = (0.25, 0.25, 0.20, 0.15, 0.15)
LABELS = ("Excellent", "Good", "Poor", "Critical")
CHRONIC = 3
CELL_LIMIT = 32_767
