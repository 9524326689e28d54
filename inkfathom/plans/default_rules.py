"""The built-in rules. KINDS in the order tried; every topic that matches applies."""

# Kinds.
KINDS = [
    {"name": "code", "code_langs": ["*"], "apps": ["com.termux", "com.github.android", "io.spck", "ru.iiec.pydroid3", "com.aide.ui", "com.foxdebug.acode"]},
    {
        "name": "receipt",
        "qr_types": ["payment"],
        "apps": ["my.com.gxbank", "com.maybank2u", "my.com.tngdigital", "com.cimb", "my.com.bankislam", "com.rhbgroup", "my.com.hongleongconnect", "com.publicbank", "com.hata.exchange", "ag.jup.jupiter"],
        "text": [r"\b(payment|transfer|cash in|top up|reload)\s+(successful|completed|received)\b", r"\b(transaction|reference)\s+(id|no)\b", r"\bresit\b", r"\bpembayaran berjaya\b", r"\bduitnow\b"],
    },
    {"name": "game", "apps": ["com.nianticlabs", "com.roblox", "com.tencent.ig", "com.supercell", "com.mojang"]},
    {"name": "chat", "apps": ["com.whatsapp", "org.telegram", "com.microsoft.teams", "com.facebook.orca", "com.discord", "jp.naver.line"]},
    {"name": "email", "apps": ["com.google.android.gm", "com.hihonor.email", "com.microsoft.office.outlook"]},
    {"name": "social", "apps": ["com.instagram", "com.linkedin", "com.ss.android.ugc", "com.zhiliaoapp", "com.facebook.katana", "com.twitter", "com.x"]},
    {"name": "document", "apps": ["com.hihonor.hnoffice", "com.microsoft.office", "com.adobe.reader", "com.google.android.apps.docs", "com.nukleus"]},
    {"name": "system", "apps": ["com.hihonor.android.launcher", "com.hihonor.assistant", "com.hihonor.magictranslate", "com.android.settings", "com.google.android.apps.nexuslauncher", "com.sec.android.app.launcher", "com.android.systemui"]},
    {"name": "web", "apps": ["com.android.chrome", "org.mozilla", "com.google.android.googlequicksearchbox", "com.brave", "com.openai.chatgpt"]},
]
# Topics.
TOPICS = [
    {"name": "security", "text": [r"\b(cyber ?security|infosec|malware|ransomware|infostealer|phishing|threat (hunting|intel(ligence)?)|data loss prevention|incident response|devsecops|osint|exfiltration|privilege escalation|zero[- ]day|cve-\d{4}-\d+|google dork(s|ing)?|dorking|reconnaissance|attack surface)\b"]},
    {
        "name": "security",
        "text_min": 2,
        "text": [
            r"\b(stealer|trojan|botnet|backdoor|rootkit|spyware|dropper|exploit(s|ed|ation)?|vulnerabilit(y|ies))\b",
            r"\b(attacker|adversar(y|ies)|persistence|lateral movement|command and control|c2|launch(daemon|agent)s?)\b",
            r"\b(soc|siem|edr|xdr|dlp|iocs?|mitre|att&ck|pentest(ing)?|red team|blue team|telemetry)\b",
            r"\b(data protection|governance, risk|grc|secure by design|access control|security (blog|research|awareness|operations|controls?|posture))\b",
            r"\b(keychain|credentials?|password (abuse|theft|dump|spray)|brute[- ]force|unauthori[sz]ed access)\b",
            r"\b(hunt(ing|able)?|detection (rule|engineering)|threat actors?|footprint(ing)?|endpoint security|process chain)\b",
            r"\b(classification|crown jewels|least privilege|accountability)\b",
        ],
    },
    {
        "name": "jobs",
        "text_min": 2,
        "text": [
            r"\b(we.?re hiring|hiring|job (opportunity|vacancy|opening|description)|role vacancy|vacancy|kerja kosong|jawatan kosong|career opportunit(y|ies)|open (role|position)s?)\b",
            r"\b(requirements?|responsibilities|qualifications?|years? of experience|apply (now|here|via)|send (your )?(cv|resume)|job type|full[- ]time|hybrid|remote)\b",
        ],
    },
    {
        "name": "ai",
        "text_min": 2,
        "text": [
            r"\b(llms?|large language models?|genai|generative ai|gpt-?\d|chatgpt|claude|gemini|openai|anthropic|hugging ?face|rag|retrieval[- ]augmented|embeddings?|fine[- ]tun(e|ing)|agentic|ai agents?|mcp|prompt(s| engineering)?|transformers?|diffusion)\b",
            r"\b(model|inference|dataset|training|tokens?|context window|benchmark|open[- ]source|weights|github)\b",
        ],
    },
    {
        "name": "learning",
        "text_min": 2,
        "text": [
            r"\bcertificate of completion\b",
            r"\b(course|lecture|tutorial|syllabus|semester|module|lesson|curriculum|cheat ?sheet|kursus|kuliah|workshop|training|bootcamp)\b",
            r"\b(assignment|submission|quiz|exam|midterm|tugasan|peperiksaan)\b",
            r"\b(machine learning|data science|deep learning|neural network|algorithm|python|javascript|sql|api)\b",
            r"\b(model|dataset|training|inference|parameters?)\b",
        ],
    },
    {
        "name": "event",
        "mode": "all",
        "text": [r"\b(register|registration|rsvp|apply now|sign up|join us|webinar|workshop|hackathon|bootcamp|summit|conference|competition|meetup|briefing|orientation|daftar|pendaftaran|pertandingan|program|seminar)\b"],
        "also": [r"(\b\d{1,2}\s*(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b(mon|tue|wed|thu|fri|sat|sun)[a-z]*day\b|\b(isnin|selasa|rabu|khamis|jumaat|sabtu|ahad)\b)"],
    },
    {
        "name": "finance",
        "qr_types": ["payment"],
        "text": [r"\b(payment|transfer|cash in|top up|reload)\s+(successful|completed|received)\b", r"\b(transaction|reference)\s+(id|no)\b", r"\bresit\b", r"\bpembayaran berjaya\b", r"\bduitnow\b", r"\b(invoice|tax invoice|bank statement|account balance)\b"],
    },
    {"name": "health", "text": [r"\b(deep sleep|rem sleep|heart rate|blood pressure|calories burned)\b", r"\b\d[\d,.]*\s*(steps|langkah)\b"]},
    {"name": "shopping", "text": [r"\b(add to cart|buy now|checkout|order (placed|confirmed)|free shipping|voucher)\b"]},
    {"name": "code", "code_langs": ["*"]},
    {"name": "health", "apps": ["com.hihonor.health", "com.huawei.health", "com.google.android.apps.fitness", "com.samsung.android.health"]},
    {"name": "shopping", "apps": ["com.shopee", "com.lazada", "com.zalora", "com.taobao", "com.alibaba"]},
    {"name": "travel", "apps": ["in.redbus", "com.airasia", "com.grabtaxi", "com.booking", "com.agoda", "hk.easyvan"]},
    {"name": "form", "domains": ["forms.gle", "docs.google.com", "typeform.com", "jotform.com", "tally.so"]},
]
