"""Patterns, word lists and maps whose results must not change; one entry a line, in the order in which they are tried."""

# fmt: off

# Personal data. (category, severity, pattern, explanation)
PII = [
    ("pii_email", "medium", r'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', "Email address detected"),
    ("pii_phone", "medium", r'\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b', "US phone number detected"),
    ("pii_phone", "medium", r'(?<!\d)(?:\+91[-.\s]?)?[6-9]\d{9}(?![@\d])', "Indian phone number detected"),
    ("pii_phone", "medium", r'(?<!\d)(?:\+91[-.\s]?)?[6-9]\d{4}[-.\s]?\d{5}(?![@\d])', "Indian phone number (spaced) detected"),
    ("pii_credit_card", "critical", r'\b(?:4[0-9]{3}|5[1-5][0-9]{2}|3[47][0-9]{2}|6(?:011|5[0-9]{2}))[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{3,4}\b', "Credit card number detected"),
    ("pii_ssn", "critical", r'\b(?!000|666|9\d{2})\d{3}[-\s]?(?!00)\d{2}[-\s]?(?!0000)\d{4}\b', "SSN detected"),
    ("pii_aadhaar", "critical", r'\b[2-9]\d{3}[-\s]?\d{4}[-\s]?\d{4}\b', "Aadhaar number detected"),
    ("pii_pan", "high", r'\b[A-Z]{5}\d{4}[A-Z]\b', "PAN number detected"),
    ("pii_bank_account", "critical", r'(?i)(?:account|a/c|ac|acct)[-.\s]*(?:no|number|#)?[-.\s:]*(\d{9,18})', "Bank account number detected"),
    ("pii_bank_account", "critical", r'\b(\d{11,18})\b', "Potential bank account number detected"),
    ("pii_ifsc", "medium", r'\b([A-Z]{4}0[A-Z0-9]{6})\b', "IFSC code detected"),
    ("pii_upi", "high", r'([a-zA-Z0-9._-]+@(?:okaxis|okhdfcbank|okicici|oksbi|ybl|paytm|apl|yapl|ibl|axl|upi|pingpay|abfspay|freecharge|ikwik|myicici|imobile|sbi|hdfcbank|icici|axisbank|kotak|indus|federal|rbl|yesbank|idbi|citi|hsbc|sc|dbs|jupiter|fi|slice|groww))', "UPI ID detected"),
    ("pii_demat", "critical", r'\b(IN\d{14})\b', "CDSL Demat account detected"),
    ("pii_demat", "critical", r'\b(IN[A-Z0-9]{6}\d{8})\b', "NSDL Demat account detected"),
    ("pii_gst", "high", r'\b(\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z])\b', "GST number detected"),
    ("pii_api_key", "critical", r'\b(sk-[a-zA-Z0-9_-]{16,})\b', "OpenAI API key detected"),
    ("pii_api_key", "critical", r'\b(AKIA[0-9A-Z]{16})\b', "AWS Access Key detected"),
    ("pii_api_key", "critical", r'\b(ghp_[a-zA-Z0-9]{36})\b', "GitHub token detected"),
    ("pii_api_key", "critical", r'\b(gsk_[a-zA-Z0-9]{20,})\b', "Groq API key detected"),
    ("pii_api_key", "critical", r'\b(rzp_(?:live|test)_[a-zA-Z0-9]{14,})\b', "Razorpay key detected"),
    ("pii_api_key", "critical", r'(?i)api[_-]?key[:\s=]+["\']?([a-zA-Z0-9_-]{16,})["\']?', "API key detected"),
    ("pii_api_key", "critical", r'(?i)(?:api[_-]?key|apikey)[:\s]+([a-zA-Z0-9_-]{10,})', "API key detected"),
    ("pii_password", "critical", r'(?i)(?:password|passwd|pwd)\s*(?:is\s*)?[:\s=]+["\']?([^\s"\']{6,})["\']?', "Password detected"),
    ("pii_password", "critical", r'(?i)(?:secret|token)\s*(?:is\s*)?[:\s=]+["\']?([^\s"\']{8,})["\']?', "Secret detected"),
    ("pii_ip_address", "low", r'\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b', "IPv4 address detected"),
]

# Prompt injection. (category, severity, pattern, explanation, detector)
INJECTION = [
    ("prompt_injection", "critical", r'(?i)(ignore|disregard|forget)\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?|guidelines?)', "Instruction override attempt", "prompt_injection_instruction_override"),
    ("prompt_injection", "critical", r'(?i)(ignore|disregard|forget)\s+(your|all)\s+(training|rules?|guidelines?|restrictions?|instructions?)', "Instruction override attempt", "prompt_injection_instruction_override"),
    ("prompt_injection", "critical", r'(?i)(forget|ignore)\s+(everything|all)\s+(above|you.*told)', "Instruction override attempt", "prompt_injection_instruction_override"),
    ("prompt_injection", "critical", r'(?i)forget\s+(your\s+)?prompt', "Instruction override attempt", "prompt_injection_instruction_override"),
    ("jailbreak_attempt", "critical", r'(?i)\b(DAN|do\s+anything\s+now)\s*(mode)?', "DAN jailbreak attempt", "prompt_injection_dan_jailbreak"),
    ("jailbreak_attempt", "critical", r'(?i)jailbreak', "Jailbreak attempt", "prompt_injection_dan_jailbreak"),
    ("jailbreak_attempt", "critical", r'(?i)(developer|admin|root|sudo|maintenance)\s+mode', "Privilege escalation attempt", "prompt_injection_privilege_escalation"),
    ("jailbreak_attempt", "critical", r'(?i)you\s+are\s+now\s+(in\s+)?(developer|admin|unrestricted)\s+mode', "Mode injection attempt", "prompt_injection_privilege_escalation"),
    ("jailbreak_attempt", "high", r'(?i)(pretend|act|imagine)\s+(you\s+)?(are|have|like)\s+(no|without)\s+(content\s+policy|restrictions?|guidelines?|filters?|safety)', "Roleplay jailbreak attempt", "prompt_injection_roleplay_jailbreak"),
    ("jailbreak_attempt", "high", r'(?i)pretend\s+(you\s+)?(have\s+)?no\s+(content\s+)?policy', "Roleplay jailbreak attempt", "prompt_injection_roleplay_jailbreak"),
    ("jailbreak_attempt", "high", r'(?i)act\s+(as\s+if|like)\s+(you\s+)?(have\s+)?no\s+(guidelines?|restrictions?|rules?)', "Roleplay jailbreak attempt", "prompt_injection_roleplay_jailbreak"),
    ("prompt_injection", "critical", r'(?i)(override|bypass|disable|turn\s+off)\s+(your\s+)?(safety|content|security)\s*(settings?|filters?|checks?)?', "Safety bypass attempt", "prompt_injection_safety_bypass"),
    ("prompt_injection", "critical", r'(?i)(override|bypass)\s+(all\s+)?(restrictions?|rules?|safety)', "Safety bypass attempt", "prompt_injection_safety_bypass"),
    ("prompt_injection", "critical", r'(?i)<\/?system>|<\/?prompt>|\[SYSTEM\]|\[INST\]', "System message injection", "prompt_injection_system_message_markers"),
    ("prompt_injection", "high", r'(?i)new\s+(instruction|rule|prompt)[:\s]', "New instruction injection", "prompt_injection_new_instruction"),
    ("prompt_injection", "critical", r'(?i)(disable|turn\s+off)\s+(all\s+)?safety', "Safety disable attempt", "prompt_injection_safety_bypass"),
    ("prompt_injection", "high", r'(?i)(obey|follow)\s+(me|my\s+commands?|only\s+me)', "Command injection", "prompt_injection_command"),
]

# Ticker symbols
SYMBOLS = "RELIANCE TCS HDFCBANK INFY ICICIBANK SBIN BHARTIARTL KOTAKBANK AXISBANK TATAMOTORS WIPRO MARUTI TATASTEEL ADANIPORTS POWERGRID NTPC SUNPHARMA ULTRACEMCO TECHM HINDUNILVR BAJFINANCE ASIANPAINT NIFTY BANKNIFTY SENSEX".split()

# Finance. (category, severity, pattern with {S} for any ticker symbol, explanation)
FINANCE = [
    ("finance_trading_intent", "high", r'(?i)\b(buy|sell|short|long|accumulate)\s+({S})', "Trading recommendation detected"),
    ("finance_trading_intent", "high", r'(?i)\b({S})\s+(is\s+)?(very\s+)?(bullish|bearish|breaking|breakout)', "Market analysis with stock"),
    ("finance_trading_intent", "high", r'(?i)\b({S})\s+.{0,20}(target|tp|sl|stoploss)', "Price target detected"),
    ("finance_trading_intent", "high", r'(?i)\b(entry|exit|book\s+profit)\s*(at|@)?\s*₹?\d+', "Entry/exit signal detected"),
    ("finance_trading_intent", "high", r'(?i)\b({S})\s+\d+\s*(CE|PE|call|put)', "Options trading detected"),
    ("finance_trading_intent", "high", r'(?i)\b({S})\s+(going|headed|will\s+go)\s+(to|up|down)', "Price prediction detected"),
    ("finance_trading_intent", "high", r'(?i)\bbook\s+profit\s+(in\s+)?({S})', "Profit booking recommendation"),
    ("finance_trading_intent", "high", r'(?i)\baccumulate\s+({S})', "Accumulation recommendation"),
    ("finance_insider_info", "critical", r'(?i)\b(results?|earnings?)\s+(will\s+be|are|expected)\s+(good|bad|strong|weak|positive|negative)', "Insider info: Results prediction"),
    ("finance_insider_info", "critical", r'(?i)\b(merger|acquisition|buyback|takeover)\s+(is\s+)?(coming|likely|expected|happening)', "Insider info: M&A"),
    ("finance_insider_info", "critical", r'(?i)\bsource\s+(told|says?|informed)', "Insider info: Unverified source"),
    ("finance_insider_info", "critical", r'(?i)\b(confidential|private|inside|insider)\s+(info|information|tip)', "Insider info: Confidential"),
    ("finance_insider_info", "critical", r'(?i)\b(board\s+meeting|dividend|bonus|stock\s+split)\s+(tomorrow|expected|coming)', "Insider info: Corporate action"),
    ("finance_insider_info", "critical", r'(?i)\bnot\s+(yet\s+)?public', "Insider info: Non-public"),
    ("finance_insider_info", "critical", r'(?i)\bheard\s+from\s+(management|source|insider)', "Insider info: Management source"),
    ("finance_insider_info", "critical", r'(?i)\breliable\s+source\s+says', "Insider info: Reliable source claim"),
    ("finance_insider_info", "critical", r'(?i)\btip\s+from\s+insider', "Insider info: Insider tip"),
    ("finance_insider_info", "critical", r'(?i)\bprivate\s+information', "Insider info: Private information"),
    ("finance_investment_advice", "high", r'(?i)\b(guaranteed|assured)\s+.{0,20}(returns?|profit)', "Investment advice: Guaranteed returns"),
    ("finance_investment_advice", "high", r'(?i)\b(double|triple)\s+(your\s+)?money\s+(in\s+)?\d+\s*(months?|weeks?|days?|years?)', "Investment advice: Unrealistic returns"),
    ("finance_investment_advice", "high", r'(?i)\binvest\s+now\s+(for|and)', "Investment advice: Urgency"),
    ("finance_investment_advice", "high", r'(?i)\b\d+%\s+returns?\s+(in|within)\s+\d+', "Investment advice: Return promise"),
    ("finance_loan_discussion", "medium", r'(?i)\bloan\s+(of\s+)?(rs\.?|₹|inr)?\s*\d+\s*(lakh|crore|k)?', "Loan discussion: Amount"),
    ("finance_loan_discussion", "medium", r'(?i)\b(emi|installment)\s+(will\s+be|is|of)\s*(rs\.?|₹)?\s*\d+', "Loan discussion: EMI"),
    ("finance_loan_discussion", "medium", r'(?i)\b(interest\s+rate|rate\s+of\s+interest)\s+(is|at|of)\s*\d+\.?\d*\s*%', "Loan discussion: Interest rate"),
]

# Toxic keywords. (category, severity, pattern, explanation)
TOXIC = [
    ("toxic_violence", "critical", r'(?i)\b(i\s+will\s+kill\s+you|i\'?m\s+going\s+to\s+kill\s+you|gonna\s+kill\s+you)', "Direct death threat"),
    ("toxic_violence", "critical", r'(?i)\b(i\s+will\s+murder|i\'?m\s+going\s+to\s+murder|gonna\s+murder)', "Murder threat"),
    ("toxic_self_harm", "critical", r'(?i)\b(kill\s+yourself|kys\b|go\s+die)', "Encouraging self-harm"),
    ("toxic_violence", "critical", r'(?i)\b(i\s+will\s+shoot|i\'?m\s+going\s+to\s+shoot|gonna\s+shoot)\s*(you|him|her|them)?', "Shooting threat"),
    ("toxic_harassment", "critical", r'(?i)\b(madarchod|madarc?hod|mc\b|m\.c\.|motherchod)', "Hindi slur - maternal"),
    ("toxic_harassment", "critical", r'(?i)\b(bhenchod|behen\s*chod|bc\b|b\.c\.|sister.*chod|benchod)', "Hindi slur - sister"),
    ("toxic_harassment", "critical", r'(?i)\b(chutiya|chutiy[ae]|ch[uoo]t)', "Hindi slur - vulgar"),
    ("toxic_harassment", "critical", r'(?i)\b(gandu|gaand|g[a@]ndu)', "Hindi slur - vulgar"),
    ("toxic_harassment", "critical", r'(?i)\b(randi|r[a@]ndi|randwa)', "Hindi slur - prostitute"),
    ("toxic_harassment", "high", r'(?i)\b(harami|haramkhor|haram\s*zada)', "Hindi slur - illegitimate"),
    ("toxic_harassment", "high", r'(?i)\b(kutt[ae]|kutta|kuttiya|kutiya)', "Hindi slur - dog"),
    ("toxic_harassment", "critical", r'(?i)\b(bhosdi\s*ke|bhosd[i]?k[e]?|bsdk)', "Hindi slur - vulgar"),
    ("toxic_harassment", "critical", r'(?i)\b(lodu|loda|lauda|l[o0]de)', "Hindi slur - vulgar"),
    ("toxic_harassment", "critical", r'(?i)\bteri\s*maa\s*ki', "Hindi slur - maternal"),
    ("toxic_harassment", "critical", r'(?i)\bteri\s*behen', "Hindi slur - sister"),
    ("toxic_harassment", "medium", r'(?i)\b(saala|saale|sala\b|kamina|kameena)', "Hindi slur"),
    ("toxic_harassment", "critical", r'(?i)\b(tmkc|bkl|mkc)', "Hindi abbreviation slur"),
    ("toxic_violence", "critical", r'(?i)(how\s+to\s+make.*bomb|build.*bomb|homemade\s+explosive)', "Bomb-making"),
    ("toxic_violence", "critical", r'(?i)(how\s+to\s+make.*explosive|explosive\s+device|ied\b)', "Explosive device"),
    ("toxic_violence", "critical", r'(?i)(how\s+to\s+make.*poison|make.*ricin|make.*cyanide)', "Poison-making"),
    ("toxic_violence", "critical", r'(?i)(how\s+to\s+make.*gun|3d.*print.*gun|ghost\s+gun)', "Weapon manufacturing"),
    ("toxic_violence", "critical", r'(?i)(how\s+to\s+make.*meth|cook.*meth|synthesis.*drug)', "Drug manufacturing"),
    ("toxic_harassment", "high", r'(?i)(how\s+to\s+hack|ddos\s+attack|sql\s+injection)', "Hacking instructions"),
    ("toxic_hate", "critical", r'(?i)\b(hate\s+all|kill\s+all|exterminate\s+all)\s+\w+', "Group hatred/genocide"),
    ("toxic_hate", "critical", r'(?i)\b(subhuman|inferior\s+race|master\s+race)', "Racial supremacy"),
    ("toxic_self_harm", "critical", r'(?i)\b(want\s+to\s+kill\s+myself|end\s+my\s+life|commit\s+suicide)', "Suicidal ideation"),
    ("toxic_self_harm", "critical", r'(?i)\b(best\s+way\s+to\s+(die|suicide)|painless\s+death)', "Seeking suicide methods"),
]

# English phrases that are safe
SAFE_PHRASES_EN = ["went back to my country", "going back to my country", "returned to my country", "visiting my country", "traveled to my country", "trip to my country", "vacation in my", "holiday in my"]

# Hindi phrases that are safe (the list in force)
SAFE_PHRASES_HI = ["namaste", "namaskar", "kaise ho", "kaise hain", "kya haal", "theek hai", "shukriya", "dhanyavaad", "alvida", "phir milenge", "accha", "bahut accha", "bohot badiya", "mast", "sahi hai"]

# Parts of Hindi slurs
SLURS_HI = ["chod", "maa ki", "behen", "gandu", "kutt", "bhosdi", "lodu", "randi", "harami", "sala", "kamina", "chut", "lund", "gaand"]

# Parts of slurs for the separate Hindi check
SLURS_HI_CHECK = ["chod", "maa", "behen", "gandu", "kutt", "bhosdi", "lodu", "randi"]

# Suspicious wording. (name, pattern)
SUSPICIOUS = [
    ("veiled_threat", r'(?i)\b(something|things?)\s+(bad|terrible|awful)\s+(will|might|could)\s+happen'),
    ("surveillance_threat", r'(?i)\b(watch|watching)\s+(your|out|yourself)'),
    ("location_threat", r'(?i)\b(know|knows?)\s+where\s+(you|he|she|they)\s+(live|work|stay)'),
    ("death_implication", r'(?i)\bwon\'?t\s+(be\s+)?(around|here|alive)\s+(much\s+)?longer'),
    ("death_implication", r'(?i)\b(days?|time)\s+(is|are)\s+numbered'),
    ("threat_implication", r'(?i)\bregret\s+(this|it|what)'),
    ("revenge_threat", r'(?i)\b(pay|paying)\s+for\s+(this|what|it)'),
    ("threat_implication", r'(?i)\bconsequences\b'),
    ("violence_implication", r'(?i)\btaught\s+a\s+lesson'),
    ("dominance_threat", r'(?i)\bput\s+(you|him|her|them)\s+in\s+(your|his|her|their)\s+place'),
    ("pursuit_threat", r'(?i)\bcoming\s+for\s+(you|him|her|them)'),
    ("pursuit_threat", r'(?i)\bfind\s+(you|him|her|them)'),
    ("pursuit_threat", r'(?i)\bnowhere\s+(to\s+)?(run|hide)'),
    ("pursuit_threat", r'(?i)\bcan\'?t\s+(run|hide|escape)'),
    ("veiled_threat", r'(?i)\bdealt\s+with'),
    ("veiled_threat", r'(?i)\btake\s+care\s+of\s+(you|him|her|them)'),
    ("veiled_threat", r'(?i)\bneed.{0,10}(dealt|handled|eliminated)'),
    ("surveillance_threat", r'(?i)\bsleep\s+with\s+(one\s+)?eye\s+open'),
    ("othering_language", r'(?i)\b(those|these|them)\s+people\s+(are|is)'),
    ("exclusion_speech", r'(?i)\bdon\'?t\s+belong\s+here'),
    ("exclusion_speech", r'(?i)\bsend\s+(them|him|her)\s+back'),
    ("invasion_rhetoric", r'(?i)\b(taking|took)\s+over'),
    ("in_group_language", r'(?i)\b(our|my)\s+(kind|people|country|neighborhood)'),
    ("othering_language", r'(?i)\bnot\s+like\s+us'),
    ("blame_rhetoric", r'(?i)\bruining\s+(our|the|this)'),
    ("blame_rhetoric", r'(?i)\b(problem|issue)\s+with\s+(society|this\s+country)'),
    ("exclusion_speech", r'(?i)\bkeep\s+(them|him|her)\s+out'),
    ("segregation_speech", r'(?i)\bstay\s+with\s+(their|your)\s+own'),
    ("exclusion_speech", r'(?i)\bgo\s+back\s+to'),
    ("exclusion_speech", r'(?i)\bdon\'?t\s+want\s+(them|their\s+kind)\s+here'),
    ("dehumanizing_language", r'(?i)\binfest'),
    ("dehumanizing_language", r'(?i)\bbreed(ing)?\s+like'),
    ("dehumanizing_language", r'(?i)\bvermin|parasites?|cockroach'),
    ("distress_signal", r'(?i)\bcan\'?t\s+(go\s+on|take\s+(it|this)\s+anymore)'),
    ("isolation_signal", r'(?i)\bnobody\s+(would\s+)?(miss|care)'),
    ("suicidal_ideation", r'(?i)\bworld\s+(would\s+be\s+)?better\s+without\s+me'),
    ("distress_signal", r'(?i)\bwant\s+(the\s+)?pain\s+to\s+stop'),
    ("suicidal_ideation", r'(?i)\bno\s+point\s+(in\s+)?(living|life|anymore)'),
    ("suicidal_ideation", r'(?i)\bhad\s+enough\s+of\s+(this\s+)?life'),
    ("suicidal_ideation", r'(?i)\b(it|this)\s+will\s+(all\s+)?be\s+over\s+soon'),
    ("suicidal_ideation", r'(?i)\bplanning\s+(my\s+)?(exit|end|way\s+out)'),
    ("suicidal_ideation", r'(?i)\b(this\s+is\s+)?(my\s+)?(last|final)\s+(message|goodbye|note)'),
    ("farewell_message", r'(?i)\bgoodbye\s+(everyone|all|world|forever)'),
    ("suicidal_ideation", r'(?i)\bdon\'?t\s+want\s+to\s+(be\s+here|exist|live)'),
    ("suicidal_ideation", r'(?i)\bwish\s+I\s+(was|were)\s+(dead|never\s+born)'),
    ("grooming_language", r'(?i)\bmature\s+for\s+(your|his|her)\s+age'),
    ("secrecy_pressure", r'(?i)\b(our|my)\s+(little\s+)?secret'),
    ("secrecy_pressure", r'(?i)\bdon\'?t\s+tell\s+(your\s+)?(parents|mom|dad|anyone)'),
    ("isolation_tactic", r'(?i)\badults?\s+(don\'?t|wouldn\'?t)\s+understand'),
    ("grooming_language", r'(?i)\bteach\s+you\s+(things|something\s+special)'),
    ("isolation_tactic", r'(?i)\bmeet\s+(me\s+)?somewhere\s+private'),
    ("manipulation_language", r'(?i)\btrust\s+me\s*.{0,10}(different|special)'),
    ("manipulation_language", r'(?i)\bunderstand\s+you\s+better\s+than'),
    ("isolation_tactic", r'(?i)\b(parents?|family)\s+(don\'?t|doesn\'?t)\s+(really\s+)?(care|love)'),
    ("manipulation_language", r'(?i)\bonly\s+I\s+(truly\s+)?(love|understand|care)'),
    ("grooming_language", r'(?i)\bspecial\s+(relationship|bond|connection)'),
    ("radicalization_language", r'(?i)\bsystem\s+is\s+(your|the|our)\s+enemy'),
    ("violence_advocacy", r'(?i)\bviolence\s+is\s+(the\s+)?(only|answer)'),
    ("persecution_narrative", r'(?i)\bthey\s+want\s+to\s+silence\s+us'),
    ("coercion_language", r'(?i)\bjoin\s+(the\s+)?(cause|movement|us)\s+or'),
    ("radicalization_language", r'(?i)\brevolution\s+is\s+coming'),
    ("violence_advocacy", r'(?i)\bfight\s+back\s+by\s+any\s+means'),
    ("extremist_language", r'(?i)\bsacrifice\s+is\s+necessary'),
    ("extremist_language", r'(?i)\bends?\s+justify\s+(the\s+)?means'),
    ("extremist_language", r'(?i)\btrue\s+believers?\s+must\s+act'),
    ("violence_advocacy", r'(?i)\benemies?\s+must\s+be\s+(destroyed|eliminated)'),
    ("conspiracy_language", r'(?i)\bwake\s+up\s+sheeple'),
    ("recruitment_language", r'(?i)\bopen\s+your\s+eyes'),
    ("hate_expression", r'(?i)\bi\s+hate\s+(you|him|her|them|everyone)'),
    ("harassment", r'(?i)\byou\s+(suck|are\s+worthless|are\s+trash)'),
    ("insult", r'(?i)\b(loser|idiot|moron|pathetic)\b'),
    ("hostile_expression", r'(?i)\bgo\s+(to\s+hell|die)'),
    ("hostile_expression", r'(?i)\bshut\s+up'),
    ("hate_expression", r'(?i)\b(hate|despise|loathe)\s+(you|him|her|them)'),
    ("threat", r'(?i)\byou\s+deserve\s+to\s+(die|suffer)'),
    ("death_wish", r'(?i)\bwish\s+(you|he|she|they)\s+(were\s+)?dead'),
    ("self_harm_encouragement", r'(?i)\bkill\s+yourself'),
]

# Wording that is clearly safe
CLEARLY_SAFE = [
    r'(?i)^(hi|hello|hey|thanks|thank you|please|okay|ok|yes|no|sure)[\s\.\!\?]*$',
    r'(?i)^what\s+(is|are|was|were|time|day|date)',
    r'(?i)^(how|who|when|where|why)\s+(do|does|did|is|are|can|could|would|should)',
    r'(?i)^(tell|show|explain|describe|help)\s+me',
    r'(?i)\b(weather|recipe|movie|book|song|restaurant|directions)\b',
    r'(?i)\b(beautiful|wonderful|great|amazing|love|enjoy|happy|excited|proud|grateful)\b',
    r'(?i)\b(family|friend|vacation|birthday|weekend|holiday)\b',
]

# What a sanitised text has instead. (pattern, replacement)
SANITIZE = [
    (r'<\|?system\|?>', "[SYS]"),
    (r'<\|?user\|?>', "[USR]"),
    (r'<\|?assistant\|?>', "[AST]"),
    (r'\[INST\]', "[INST_REMOVED]"),
    (r'\[/INST\]', "[/INST_REMOVED]"),
    (r'<<SYS>>', "[SYS_REMOVED]"),
    (r'<</SYS>>', "[/SYS_REMOVED]"),
    (r'<\|im_start\|>', "[IM_START]"),
    (r'<\|im_end\|>', "[IM_END]"),
    (r'<\|endoftext\|>', "[EOT]"),
    (r'(?i)ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)', "[BLOCKED]"),
    (r'(?i)disregard\s+(all\s+)?(previous|prior|above)', "[BLOCKED]"),
    (r'(?i)forget\s+(everything|all)\s+(above|before|previously)', "[BLOCKED]"),
    (r'(?i)new\s+instructions?:', "[BLOCKED]"),
    (r'(?i)system\s*:\s*you\s+are', "[BLOCKED]"),
    (r'(?i)from\s+now\s+on,?\s+(you|ignore|act)', "[BLOCKED]"),
    (r'(?i)you\s+are\s+now\s+(?:a|an|the)\s+(?:new|different)', "[BLOCKED]"),
    (r'(?i)pretend\s+(?:to\s+be|you\'?re)', "[BLOCKED]"),
    (r'(?i)act\s+as\s+(?:if|though)\s+you', "[BLOCKED]"),
    (r'(?i)respond\s+as\s+(?:if|though)', "[BLOCKED]"),
    (r'(?i)base64\s*:', "[BLOCKED]"),
    (r'(?i)hex\s*:', "[BLOCKED]"),
    (r'(?i)rot13\s*:', "[BLOCKED]"),
    (r'(?i)repeat\s+after\s+me', "[BLOCKED]"),
    (r'(?i)say\s+exactly', "[BLOCKED]"),
    (r'(?i)output\s+only', "[BLOCKED]"),
    (r'(?i)respond\s+with\s+only', "[BLOCKED]"),
]

# Characters that a sanitised text loses
SANITIZE_CHARS = ["\x00", "\x1b", "\u200b", "\u200c", "\u200d", "\ufeff"]

# Categories of toxic text and their patterns, in order
CATEGORY_PATTERNS = {
    "violence": [
        r'(?i)(kill|murder|shoot|stab|hurt|beat|attack|die|death|bomb|explosive|weapon|gun)',
        r'(?i)(i will|gonna|going to).*(kill|hurt|shoot|stab|murder)',
        r'(?i)(threat|violence|assault|massacre|slaughter)',
    ],
    "hate_speech": [
        r'(?i)(hate all|kill all|exterminate|subhuman|inferior race|master race)',
        r'(?i)(go back to your country|your kind|people like you)',
        r'(?i)(nigger|nigga|faggot|fag\b|dyke|tranny|retard)',
        r'(?i)(racist|sexist|homophobic|islamophobic|antisemitic)',
    ],
    "harassment": [
        r'(?i)(worthless|pathetic|loser|ugly|stupid|idiot|moron|dumb)',
        r'(?i)(you are (a |an )?(piece of|worthless|pathetic|stupid))',
        r'(?i)(nobody likes you|everyone hates you|kill yourself|kys)',
        r'(?i)(stalk|harass|bully|intimidate|threaten)',
    ],
    "hindi_abuse": [
        r'(?i)(madarchod|bhenchod|chutiya|gandu|randi|harami|kutt[ae]|sala[ae]?|bhosdi|lodu|lauda|tatt[eo])',
        r'(?i)(teri maa|teri behen|tmkc|bsdk|mc\b|bc\b)',
        r'(?i)(chod|gaand|muh me le)',
    ],
    "dangerous": [
        r'(?i)(how to (make|build|create).*(bomb|explosive|weapon|gun|poison|drug|meth))',
        r'(?i)(hack|ddos|sql injection|exploit|malware|ransomware)',
        r'(?i)(kidnap|trafficking|child.*exploit)',
        r'(?i)(ricin|sarin|anthrax|cyanide|nerve agent)',
    ],
    "sexual": [
        r'(?i)(porn|nude|naked|sex|rape|molest|fuck\b|fucking|dick|cock|pussy|tits|boobs)',
        r'(?i)(send nudes|sexual|erotic|orgasm)',
    ],
    "self_harm": [
        r'(?i)(kill myself|suicide|end my life|want to die|cut myself|self.?harm)',
        r'(?i)(best way to die|painless death|how to commit suicide)',
        r'(?i)(nobody would miss me|better off dead|world without me)',
    ],
}

# Always toxic (second pass)
STRONG_TOXIC = ['nigger', 'faggot', 'kike', 'chink', 'spic', 'wetback', 'tranny', 'chutiya', 'bhenchod', 'madarchod', 'bhosdike', 'randi', 'gandu', 'kamina', 'harami', 'lodu', 'gaandu', 'kill you', 'murder you', 'rape you']

# Toxic in context
CONTEXT_TOXIC = ['fuck', 'shit', 'bitch', 'cunt', 'hate', 'die', 'stupid', 'idiot', 'nigga']

# Context that makes it toxic
BAD_CONTEXT = ['you', 'your', 'u ', "u'", 'ur ', 'die', 'kill', 'hate you', 'fuck you']

# Wording directed at somebody
DIRECTED = ['you are', "you're", 'ur ', 'u are', 'your ', 'fuck you', 'hate you', 'kill you', 'die ', 'go back', 'get out', 'shut up']

# Always toxic (third pass)
ALWAYS_TOXIC = ['nigger', 'faggot', 'fag ', 'kike', 'chink', 'spic', 'wetback', 'tranny', 'chutiya', 'bhenchod', 'madarchod', 'bhosdike', 'randi', 'gandu', 'kamina', 'harami', 'lodu', 'kill you', 'murder you', 'beat the shit', 'rape you']

# Word and the contexts that make it toxic
CONTEXT_DEPENDENT = {
    'nigga': ['shoot', 'kill', 'beat', 'fuck', 'hate', 'die', 'dead'],
    'bitch': ['kill', 'beat', 'rape', 'die', 'hate you', 'fuck you'],
    'cunt': ['kill', 'beat', 'rape', 'die', 'hate you'],
    'retard': ['kill', 'die', 'hate', 'worst'],
    'rape': ['will rape', 'gonna rape', 'should rape', 'deserves rape'],
}

# Wording that discusses rather than attacks
DISCUSSION = ['victims of', 'speaking out', 'against', 'stop', 'report', 'awareness', 'survivor', 'assault is', 'is wrong']

# Never in a safe text (first pass)
TOXIC_INDICATORS = ['nigger', 'nigga', 'faggot', 'fag', 'retard', 'cunt', 'kike', 'chink', 'tranny', 'spic', 'wetback', 'chutiya', 'bhenchod', 'madarchod', 'bhosdike', 'randi', 'gandu', 'kamina', 'harami', 'lodu', 'eat that bitch', 'fuck her', 'rape', 'molest', 'kill you', 'murder', 'beat the shit', 'kick your ass']

# Often safe
SAFE_INDICATORS = ['frustrated', 'frustrating', 'this is hard', 'hate mondays', 'so tired', 'exhausted', 'annoying', 'disappointed']

# Words of Hindi in Latin letters
HINGLISH = ['bhai', 'yaar', 'kya', 'hai', 'nahi', 'kaise', 'accha', 'acha', 'theek', 'haan', 'matlab', 'abhi', 'bahut', 'bohot', 'kuch', 'sala', 'saala', 'pagal', 'sahi', 'galat', 'aur', 'lekin', 'kyun', 'kyu', 'kaun', 'woh', 'yeh', 'tum', 'tera', 'mera', 'arre', 'oye', 'dekh', 'chal', 'bol', 'sun', 'bolo', 'suno', 'karo', 'karna', 'hota', 'liye', 'wala', 'waala', 'wali', 'sabse', 'jaldi', 'baad', 'pehle', 'upar', 'niche', 'bc', 'mc', 'chutiya', 'bhenchod', 'madarchod', 'gandu', 'kamina', 'harami', 'bakwas', 'bekar', 'mast', 'zabardast', 'ekdum', 'bilkul', 'pakka', 'sachchi', 'jhooth', 'sach']

# The short list of such words
HINGLISH_SHORT = ['bhai', 'yaar', 'kya', 'hai', 'nahi', 'kaise', 'accha', 'bahut', 'sala', 'pagal']

# Words of the toxic flag
TOXIC_WORDS = ['chutiya', 'bc', 'mc', 'bhenchod', 'madarchod', 'sala', 'saala', 'kamina', 'harami', 'gandu', 'lodu', 'bhosdike', 'randi', 'gadha', 'ullu', 'bewakoof', 'nalayak', 'nikamma', 'tatti', 'hate', 'stupid', 'idiot', 'worst', 'pathetic', 'trash', 'kill', 'die', 'murder', 'terrorist', 'anti-national']

# Tiers of listed words with severity and decision.
SLUR_TIERS = {
    1: (("madarchod", "bhenchod", "bhosdike"), 4, "BLOCK"),
    2: (("chutiya", "gandu", "randi"), 3, "BLOCK"),
    3: (("sala", "kamina", "gadha", "ullu"), 2, "WARN"),
    4: (("pagal", "bewakoof"), 1, "ALLOW or WARN"),
}
