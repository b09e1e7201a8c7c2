"""The security patterns of each language, as (type, severity, pattern); the order is that of evaluation."""

PYTHON = (
    ("SQL Injection", "critical", r'(?i)(?:execute|executemany|executequery)\s*\(\s*[f]{0,1}[\'"][^\'"\)]*?(?:%s|%d)[^\'"\)]*?[\'"]'),
    ("SQL Injection", "critical", r'(?i)(?:execute|executemany|executequery)\s*\(\s*.*?\.format\('),
    ("SQL Injection", "critical", r'(?i)(?:execute|executemany|executequery)\s*\(\s*f[\'"][^\'"]*\{[^\}]*\}[^\'"]*[\'"]'),
    ("Insecure Subprocess", "high", r'(?i)(?:os\.system|subprocess\.(?:call|run|Popen|check_output)).*?shell\s*=\s*True'),
    ("Command Injection", "critical", r'(?i)(?:os\.system|subprocess\.(?:call|run|Popen|check_output)).*\+.*(?:user_input|data|param|args|kwargs|request)'),
    ("Command Injection", "critical", r'(?i)(?:os\.system|subprocess\.(?:call|run|Popen|check_output)).*format\('),
    ("Command Injection", "critical", r'(?i)(?:os\.system|subprocess\.(?:call|run|Popen|check_output)).*f[\'"](.*?\{.*?\})'),
    ("Use of Eval", "high", r'\beval\s*\('),
    ("Use of Exec", "high", r'\bexec\s*\('),
    ("Use of Pickle", "high", r'\bpickle\.(?:load|loads)\s*\('),
    ("Unsafe YAML Loading", "high", r'(?:yaml|pyyaml)\.(?:load|unsafe_load)\s*\('),
    ("XXE Vulnerability", "high", r'(?:lxml|xml)\.etree\.ElementTree\.fromstring\(.*?user'),
    ("XXE Vulnerability", "high", r'(?:ElementTree|xml\.etree)\.parse\(.*?user'),
    ("Debug Statement Left", "low", r'import\s+pdb\b|pdb\.set_trace\s*\('),
    ("Debug Statement Left", "low", r'print\s*\(\s*[\'"]DEBUG|print\s*\(\s*f[\'"]DEBUG'),
    ("Weak Hashing Algorithm", "medium", r'\bhashlib\.md5\b'),
    ("Weak Hashing Algorithm", "medium", r'\bhashlib\.sha1\b'),
    ("Insecure Temporary File", "medium", r'\btempfile\.mktemp\b'),
    ("Use of Assert", "low", r'^\s*assert\b'),
    ("Insecure CORS Configuration", "medium", r'(?i)Access-Control-Allow-Origin[\'"\s]*:[\'"\s]*\*'),
    ("Insecure Cookie", "medium", r'(?i)set_cookie\(.*?secure\s*=\s*False'),
    ("Insecure Cookie", "medium", r'(?i)(?:set_cookie|cookie)\(.*?httponly\s*=\s*False'),
    ("Insecure JWT Verification", "high", r'(?i)jwt\.decode\(.*?verify\s*=\s*False'),
    ("Hardcoded Credentials", "high", r'(?i)(?:password|passwd|pwd|apiKey|api_key|secret|token|access_key)\s*=\s*["\'`][A-Za-z0-9_!@#$%^&*()-+={}\[\]|\\:;<>,.?\/]{8,}["\'`]'),
)
JAVASCRIPT = (
    ("Hardcoded Credentials", "high", r'(?i)(?:password|passwd|pwd|apiKey|api_key|secret|token|access_key)\s*[:=]\s*["\'`][A-Za-z0-9_!@#$%^&*()-+={}\[\]|\\:;<>,.?\/]{8,}["\'`]'),
    ("Cross-Site Scripting", "high", r'(?i)\.innerHTML\s*=|\.outerHTML\s*=|document\.write\('),
    ("Prototype Pollution", "medium", r'(?i)Object\.assign\(\s*[^,]+\s*,\s*[\w.]+\)|_*proto_*'),
    ("Prototype Modification", "medium", r'(?i)Object\.prototype\.\w+\s*='),
    ("Unsafe Code Execution", "high", r'(?i)eval\(|Function\(|new Function\(|setTimeout\(\s*["\'`]|setInterval\(\s*["\'`]'),
    ("Regular Expression DoS", "medium", r'(?i)[\w.]+\.match\(\s*\/(\.\*|\([^)]*\)\*)\/'),
    ("Timing Attack", "medium", r'(?i)===|!==|==|!=.*password|token|secret'),
    ("Insecure HTTP", "medium", r'(?i)http:\/\/(?!localhost|127\.0\.0\.1)'),
    ("Insecure Randomness", "medium", r'(?i)Math\.random\('),
    ("Cross-Site Scripting (XSS)", "high", r'(?i)(?:innerHTML|outerHTML|document\.write|document\.writeln)\s*=\s*'),
    ("Possible Code Injection", "high", r'(?i)(?:eval|setTimeout|setInterval|Function)\s*\(\s*([^\)]+)\)'),
    ("Insecure JWT Verification", "high", r'(?i)(?:jwt|jsonwebtoken)\.verify\s*\(\s*[^,]+,\s*[^,]+\s*\)'),
    ("Insecure CORS Configuration", "medium", r'(?i)Access-Control-Allow-Origin.*[\'"]\*[\'"]'),
    ("NoSQL Injection", "high", r'(?i)db\.collection\(.*?\)\.find\(\s*\{.*?\$where\s*:'),
    ("NoSQL Injection", "high", r'(?i)new\s+RegExp\(\s*(?:req|request|user|input)'),
    ("Weak Randomness", "medium", r'(?i)Math\.random\(\)'),
    ("Path Traversal", "high", r'(?i)(?:fs|require\([\'"]fs[\'"]\))\.(?:readFile|readFileSync|createReadStream)\s*\(\s*(?:req|request|user|input|query)'),
)
JAVA = (
    ("SQL Injection", "high", r'(?i)(?:executeQuery|executeUpdate|execute|prepareStatement|createStatement)\s*\(\s*(?:[\"\'`]|(?:\+\s*))(?:SELECT|UPDATE|DELETE|INSERT|REPLACE|MERGE)(?:[^\"\'`]*(?:\+\s*)?[\"\'`][^\"\'`]*)+'),
    ("SQL Injection", "medium", r'(?i)(?:executeQuery|executeUpdate|execute|prepareStatement|createStatement)\s*\(\s*(?:[^\),]*\+\s*[^\)]*)\)'),
    ("SQL Injection", "medium", r'(?i)setString\s*\(\s*\d+\s*,\s*(?:[^\),]*\+\s*[^\)]*)\)'),
    ("XML External Entity (XXE)", "high", r'(?i)(?:DocumentBuilderFactory|SAXParserFactory|XMLInputFactory)(?:(?!\.setFeature\(\s*(?:"http://apache\.org/xml/features/disallow-doctype-decl"|"http://xml\.org/sax/features/external-general-entities"|"http://xml\.org/sax/features/external-parameter-entities")|setExpandEntityReferences\s*\(\s*false\s*\))[^\)]*){20,}\.(?:newDocumentBuilder|newSAXParser|createXMLStreamReader)'),
    ("XML External Entity (XXE)", "high", r'(?i)(?:DocumentBuilderFactory|SAXParserFactory|XMLInputFactory).*\.setFeature\(\s*(?:"http://apache\.org/xml/features/disallow-doctype-decl"|"http://xml\.org/sax/features/external-general-entities"|"http://xml\.org/sax/features/external-parameter-entities")\s*,\s*false\s*\)'),
    ("Command Injection", "high", r'(?i)(?:Runtime\.getRuntime\(\)|ProcessBuilder)(?:.|\n)*?(?:exec|start)\s*\(\s*(?:[^\"\']*\+\s*|[\"\'`][^\"\'`]*\+[^\"\'`]*[\"\'`])'),
    ("Command Injection", "medium", r'(?i)(?:Runtime\.getRuntime\(\)|ProcessBuilder)(?:.|\n)*?(?:exec|start)\s*\(\s*(?:String\[\]\s*\{\s*(?:[^}]*,\s*){2,})'),
    ("Insecure Deserialization", "high", r'(?i)(?:ObjectInputStream|XMLDecoder)(?:(?!readObject\(\)|readUTF\(\)|readBoolean\(\)|readInt\(\)|readLong\(\)|readFloat\(\)|readDouble\(\)|readUnsignedByte\(\)|readUnsignedShort\(\))\S)*\.read(?:Object|External)'),
    ("Insecure Deserialization", "high", r'(?i)XStream(?:(?!\.denyTypes\(|\.addToBlacklist\(|\.setupDefaultSecurity\()\S)*\.fromXML'),
    ("Insecure Deserialization", "high", r'(?i)Yaml\.load\('),
    ("Path Traversal", "high", r'(?i)(?:new\s+File|new\s+FileInputStream|new\s+FileOutputStream|new\s+FileReader|new\s+FileWriter)\s*\(\s*(?:[^\),]*\+\s*[^\)]*)\)'),
    ("Path Traversal", "medium", r'(?i)(?:new\s+File|new\s+FileInputStream|new\s+FileOutputStream|new\s+FileReader|new\s+FileWriter)(?:(?!\.getCanonicalPath\(\)|\.normalize\(\))[^\)]*){10,}\)'),
    ("Insecure Randomness", "medium", r'(?i)new\s+Random\s*\('),
    ("Insecure Randomness", "medium", r'(?i)Math\.random\s*\('),
    ("Insecure Randomness", "low", r'(?i)SecureRandom(?:(?!\.getInstance\(\"[^\)\"]+\"\))[^\)]*){10,}\.next'),
    ("Weak Cryptography", "high", r'(?i)(?:getInstance|getEngine)\s*\(\s*[\"\'`](?:MD5|RC4|DES|3DES|DESede|AES/ECB|RC2|ARCFOUR|BLOWFISH)[\"\'`]'),
    ("Weak Cryptography", "medium", r'(?i)KeyPairGenerator(?:(?!\.initialize\s*\(\s*(?:2048|3072|4096)\s*\))[^\)]*){10,}\.generateKeyPair\(\)'),
    ("Weak Cryptography", "medium", r'(?i)Cipher\s*\.\s*getInstance\s*\(\s*[\"\'`][^\)\"\'`]*\/CBC\/PKCS5Padding[\"\'`](?:(?!\.init\s*\(\s*Cipher\.ENCRYPT_MODE[^\)]*,\s*[^\)]*IvParameterSpec)[^\)]*){20,}'),
    ("Weak Cryptography", "high", r'(?i)MessageDigest\s*\.\s*getInstance\s*\(\s*[\"\'`](?:SHA-1|MD5)[\"\'`]\s*\)'),
    ("Hardcoded Secret", "high", r'(?i)(?:password|passwd|pwd|secret|key|token|auth|credentials|api_?key)\s*=\s*[\"\'`][^\"\'\`]{8,}[\"\'`]'),
    ("Hardcoded Secret", "high", r'(?i)private\s+static\s+(?:final\s+)?(?:String|char\[\])\s+(?:password|passwd|pwd|secret|key|token|auth|credentials|api_?key)\s*=\s*[\"\'][^\"\',;]{8,}[\"\']'),
    ("Hardcoded Secret", "high", r'(?i)\.(?:authorization|authenticate|setPassword|setCredentials|setApiKey)\s*\(\s*[\"\'`][^\"\'\`]{8,}[\"\'`]\s*\)'),
    ("Sensitive Data Logging", "medium", r'(?i)(?:log|logger|System\.out|System\.err)(?:.|\n)*?(?:debug|info|warn|error|println|print|printf)\s*\(\s*(?:[^,\)]*(?:password|passwd|pwd|secret|credential|token|ssn|creditcard|credit_?card|cc_?num)[^,\)]*,|[^,\)]*(?:getPassword|getToken|getCreditCard)\s*\(\s*\)[^,\)]*,)'),
    ("Insecure Cookie", "medium", r'(?i)(?:Cookie|HttpCookie)(?:(?!\.setSecure\s*\(\s*true\s*\)|\.setHttpOnly\s*\(\s*true\s*\))[^\)]*){20,}\.(?:setValue|setPath|setDomain)'),
    ("Insecure Cookie", "high", r'(?i)(?:Cookie|HttpCookie).*\.setSecure\s*\(\s*false\s*\)'),
    ("Insecure Cookie", "high", r'(?i)(?:Cookie|HttpCookie).*\.setHttpOnly\s*\(\s*false\s*\)'),
    ("Server-Side Request Forgery (SSRF)", "high", r'(?i)(?:URL|URI|HttpURLConnection)(?:(?!\.getHost\(\)|\.getUserInfo\(\))[^\)]*){10,}\.(?:openConnection|openStream)\('),
    ("Server-Side Request Forgery (SSRF)", "medium", r'(?i)(?:OkHttpClient|HttpClient|CloseableHttpClient|RestTemplate|WebClient)(?:(?!\.setConnectTimeout\(\)|\.setReadTimeout\(\))[^\)]*){10,}\.(?:newCall|execute|exchange|get|post|put|delete)\('),
    ("CORS Misconfiguration", "high", r'(?i)response\.(?:setHeader|addHeader)\s*\(\s*[\"\'`](?:Access-Control-Allow-Origin)[\"\'`]\s*,\s*[\"\'`]\*[\"\'`]\s*\)'),
    ("CORS Misconfiguration", "medium", r'(?i)CorsConfiguration(?:(?!\.setAllowedOrigins\(\)|\\.applyPermitDefaultValues\(\))[^\)]*){10,}'),
)
PHP = (
    ("SQL Injection", "critical", r'(?i)(?:mysql_query|mysqli_query|pg_query)\s*\(\s*[\'"][^\'"]*(?:\$[a-zA-Z0-9_]+)[^\'"]*[\'"]'),
    ("SQL Injection", "critical", r'(?i)(?:->query|::query|->exec|::exec)\s*\(\s*[\'"][^\'"]*(?:\$[a-zA-Z0-9_]+|\{)[^\'"]*[\'"]'),
    ("SQL Injection", "critical", r'(?i)(?:->query|::query|->exec|::exec)\s*\(\s*(?:[\'"].*[\'"] \. \$[a-zA-Z0-9_]+)'),
    ("Command Injection", "critical", r'(?i)(?:system|exec|passthru|shell_exec|popen|proc_open)\s*\(\s*(?:\$[a-zA-Z0-9_]+|\$_(?:GET|POST|REQUEST|COOKIE))'),
    ("Command Injection", "critical", r'(?i)(?:system|exec|passthru|shell_exec|popen|proc_open)\s*\(\s*[\'"][^\'"]*(?:\$[a-zA-Z0-9_]+|\{)[^\'"]*[\'"]'),
    ("Code Injection", "critical", r'(?i)(?:eval|assert)\s*\(\s*(?:\$[a-zA-Z0-9_]+|\$_(?:GET|POST|REQUEST|COOKIE))'),
    ("Cross-Site Scripting (XSS)", "high", r'(?i)echo\s+(?:\$_(?:GET|POST|REQUEST|COOKIE)|(?:\$[a-zA-Z0-9_]+)\s*=\s*\$_(?:GET|POST|REQUEST|COOKIE))'),
    ("Cross-Site Scripting (XSS)", "high", r'(?i)print\s+(?:\$_(?:GET|POST|REQUEST|COOKIE)|(?:\$[a-zA-Z0-9_]+)\s*=\s*\$_(?:GET|POST|REQUEST|COOKIE))'),
    ("Cross-Site Scripting (XSS)", "high", r'(?i)(?:<\?=|\<\?php\s+echo)\s+\$(?:_GET|_POST|_REQUEST|_COOKIE)'),
    ("File Inclusion", "high", r'(?i)(?:include|require|include_once|require_once)\s*\(\s*\$(?:[a-zA-Z0-9_]+)'),
    ("File Inclusion", "medium", r'(?i)(?:include|require|include_once|require_once)\s+[\'"]\.\.\/'),
    ("File Upload", "medium", r'(?i)move_uploaded_file\s*\(\s*\$_FILES'),
    ("Weak File Type Validation", "high", r'(?i)if\s*\(\s*\$_FILES[^\)]*type[^\)]*==[^\)]*(?:image|application)'),
    ("File Extension Check", "medium", r'(?i)pathinfo\s*\([^\)]*PATHINFO_EXTENSION'),
    ("Insecure Session Settings", "high", r'(?i)session\.use_only_cookies\s*=\s*(?:0|false)'),
    ("Insecure Session Settings", "medium", r'(?i)session\.cookie_secure\s*=\s*(?:0|false)'),
    ("Insecure Session Settings", "medium", r'(?i)session\.cookie_httponly\s*=\s*(?:0|false)'),
    ("Weak Hashing", "medium", r'(?i)md5\s*\('),
    ("Weak Hashing", "medium", r'(?i)sha1\s*\('),
    ("Password Hashing", "low", r'(?i)(?:password_hash|crypt)\s*\([^,]*,\s*PASSWORD_DEFAULT\s*'),
    ("Debug Information Leak", "medium", r'(?i)var_dump\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE|SESSION|SERVER)'),
    ("Debug Information Leak", "medium", r'(?i)print_r\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE|SESSION|SERVER)'),
    ("Debug Setting", "low", r'(?i)error_reporting\s*\(\s*E_ALL\s*\)'),
    ("Insecure Deserialization", "high", r'(?i)unserialize\s*\(\s*(?:\$[a-zA-Z0-9_]+|\$_(?:GET|POST|REQUEST|COOKIE))'),
    ("Insecure Deserialization", "medium", r'(?i)unserialize\s*\(\s*file_get_contents\s*\(\s*(?:\$[a-zA-Z0-9_]+)'),
    ("Code Execution", "critical", r'(?i)preg_replace\s*\(\s*[\'"][^\'"]*\/e[\'"]'),
    ("Code Execution", "high", r'(?i)preg_replace\s*\(\s*\$[a-zA-Z0-9_]+'),
    ("Variable Extraction", "high", r'(?i)extract\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)'),
    ("Variable Extraction", "high", r'(?i)parse_str\s*\(\s*(?:\$[a-zA-Z0-9_]+|\$_(?:GET|POST|REQUEST|COOKIE))'),
    ("Variable Extraction", "medium", r'(?i)extract\s*\(\s*\$[a-zA-Z0-9_]+'),
)
GO = (
    ("SQL Injection", "critical", r'(?i)db\.(?:Query|QueryRow|Exec)\s*\(\s*(?:[\'"][^\'"]*[\'"] \+ |[^,]+\+)'),
    ("SQL Injection", "critical", r'(?i)db\.(?:Query|QueryRow|Exec)\s*\(\s*(?:fmt\.Sprintf\s*\(\s*[\'"][^\'"]*\%[^\'"]*[\'"])'),
    ("SQL Injection", "medium", r'(?i)db\.(?:Query|QueryRow|Exec)\s*\(\s*strings\.(?:Join|Replace)'),
    ("Command Injection", "critical", r'(?i)(?:exec\.Command|exec\.CommandContext)\s*\(\s*(?:[^,]+\s*\+\s*)'),
    ("Command Injection", "high", r'(?i)(?:exec\.Command|exec\.CommandContext)\s*\(\s*(?:fmt\.Sprintf)'),
    ("Command Injection", "high", r'(?i)(?:exec\.Command|exec\.CommandContext)\s*\(\s*(?:os\.Args|flag\.)'),
    ("Shell Command Execution", "high", r'(?i)(?:exec\.Command|exec\.CommandContext)\s*\(\s*[\'"](?:bash|sh|cmd|powershell)[\'"]\s*,\s*[\'"]-c[\'"]\s*,'),
    ("Path Traversal", "high", r'(?i)(?:os\.Open|os\.OpenFile|ioutil\.ReadFile|ioutil\.WriteFile)\s*\(\s*(?:[^)]+\+)'),
    ("Path Traversal", "high", r'(?i)filepath\.(?:Join|Clean)\s*\(\s*(?:[^,]+,\s*r\.URL\.Query\(\))'),
    ("Path Traversal", "high", r'(?i)(?:http\.ServeFile|http\.FileServer)\s*\(\s*[^,]+\s*,\s*(?:[^)]+\+)'),
    ("Weak Hashing", "high", r'(?i)crypto/md5\.'),
    ("Weak Hashing", "medium", r'(?i)crypto/sha1\.'),
    ("TLS Verification Disabled", "high", r'(?i)tls\.Config\s*\{(?:[^}]*,\s*)?InsecureSkipVerify\s*:\s*true'),
    ("Insecure TLS Version", "high", r'(?i)MinVersion\s*:\s*tls\.VersionSSL'),
    ("Weak Randomness", "medium", r'(?i)rand\.(?:Int|Intn|Float32|Float64)'),
    ("Unsafe JSON Deserialization", "low", r'(?i)json\.(?:Unmarshal|Decoder\.Decode)\s*\(\s*[^,]+\s*,\s*&map\[string\](?:interface|any)'),
    ("JSON Type Confusion", "low", r'(?i)json\.(?:Unmarshal|Decoder\.Decode).*&struct\{'),
    ("Template Injection", "medium", r'(?i)template\.(?:New|Parse|ParseFiles)\s*\([^)]*\)\.(?:Execute|ExecuteTemplate)\s*\([^,]+,\s*(?:r\.URL|r\.Form|r\.Body)'),
    ("Template Injection", "low", r'(?i)html/template\.(?:New|Parse|ParseFiles)\s*\([^)]*\)\.(?:Execute|ExecuteTemplate)\s*\([^,]+,\s*(?:r\.URL|r\.Form|r\.Body)'),
    ("Insecure HTTP", "medium", r'(?i)http\.(?:ListenAndServe|Server\s*\{[^}]*\}\.ListenAndServe)\s*\(\s*[^,]+\s*,'),
    ("Insecure CORS Configuration", "medium", r'(?i)w\.Header\(\)\.(?:Set|Add)\s*\(\s*[\'"](?:Access-Control-Allow-Origin)[\'"]\s*,\s*[\'"]\\*[\'"]\s*\)'),
    ("Security Headers Implementation", "low", r'(?i)w\.Header\(\)\.(?:Set|Add)\s*\(\s*[\'"](?:Strict-Transport-Security|X-Content-Type-Options|X-Frame-Options|Content-Security-Policy)[\'"]\s*,'),
    ("Missing Timeout/Deadline", "low", r'(?i)ctx\s*:=\s*context\.(?:Background|TODO)\(\)'),
    ("Select Without Default", "low", r'(?i)select\s*\{\s*(?:[^}]*?\s*case[^:]*:[^}]*?){2,}\s*\}'),
    ("Error Exposure", "low", r'(?i)fmt\.(?:Print|Println|Printf)\s*\(\s*err\s*\)'),
    ("Error Logging", "low", r'(?i)log\.(?:Print|Println|Printf)\s*\(\s*err\s*\)'),
    ("Error Information Leakage", "medium", r'(?i)http\.Error\s*\(\s*[^,]+\s*,\s*err\.Error\(\)'),
    ("Potential Resource Exhaustion", "low", r'(?i)for\s+[^{]*\{\s*(?:time\.Sleep|runtime\.Gosched)\s*\([^)]+\)\s*\}'),
    ("Potential Goroutine Leak", "medium", r'(?i)go\s+func\s*\([^)]*\)\s*\{(?:[^}]*?\s*for\s+[^{]*\{[^}]*?\s*\}){2,}[^}]*?\s*\}\s*\(\s*\)'),
)
RUBY = (
    ("SQL Injection", "high", r'(?i)(?:execute|select|where|update|delete).*[\+\|\.append].*(?:params|session|request|data|input|args|\$\d+)'),
    ("Command Injection", "critical", r'(?i)(?:system|exec|popen|backtick|`).*[\+\|\.append].*(?:params|session|request|data|input|args|var|env)'),
    ("Code Injection", "critical", r'(?i)(?:eval|instance_eval|class_eval|module_eval|binding\.eval).*(?:params|session|request|data|input|args|var)'),
    ("Insecure Deserialization", "high", r'(?i)(?:Marshal\.load|YAML\.load|Oj\.load).*(?:params|session|request|data|input|args|var|file|body)'),
    ("Template Injection", "high", r'(?i)render\s*\(\s*(?:inline|text|string|file|partial|template).*(?:params|session|request|data|input|args|var)'),
    ("Template Injection", "high", r'(?i)<%=.*(?:params|session|request|data|input|args|var)'),
    ("Template Injection", "high", r'(?i)["\'].*#\{.*(?:params|session|request|data|input|args|var)'),
    ("Template Injection", "high", r'(?i)render\(inline:.*params'),
    ("Object Injection", "high", r'(?i)(?:send|public_send|try|__send__).*(?:params|session|request|data|input|args|var|attr)'),
    ("Mass Assignment", "high", r'(?i)(?:create|update|new|build|assign_attributes).*\(\s*params\s*(?:\[\s*:\w+\s*\])?\s*\)'),
    ("Cross-Site Scripting", "high", r'(?i)(?:html_safe|raw|html|safe_concat|gsub|body|content_tag|concat|append|prepend|link_to|image_tag).*(?:params|session|request|data|input|args|var)'),
    ("File Access", "high", r'(?i)(?:File\.|IO\.|open|read|write).*(?:params|session|request|data|input|args|var)'),
    ("Path Traversal", "high", r'(?i)(?:Dir\.|FileUtils\.|path|directory|folder).*(?:params|session|request|data|input|args|var)'),
    ("Insecure Randomness", "medium", r'(?i)(?:rand|srand|Random\.new|SecureRandom\.rand)'),
    ("Open Redirect", "medium", r'(?i)(?:redirect_to|redirect).*(?:params|session|request|data|input|args|var)'),
    ("Insecure JWT", "high", r'(?i)(?:JWT\.|:none|alg.*none)'),
    ("Hardcoded Secret", "critical", r'(?i)(?:password|secret|token|key|credential|api_key)\s*(?:=|:)\s*[\'\"][^\'"]+[\'\"]'),
    ("CSRF Protection Bypass", "high", r'(?i)protect_from_forgery.*except|skip_before_action.*:verify_authenticity_token'),
    ("HTTP Header Tampering", "medium", r'(?i)response\.headers\[\s*[\'"]X-\w+[\'"]\s*\]\s*='),
    ("SQL Injection", "high", r'(?i)(?:find_by_sql|select|where|having|group|order).*[\?\%]\s*\{.*\}'),
    ("Insecure Cookie", "medium", r'(?i)cookies\[\s*:?\w+\s*\]\s*=|cookies\.permanent|cookies\.encrypted'),
    ("Regular Expression DoS", "medium", r'(?i)Regexp\.new|\/(?:\.\*|\\\w\+|\[\^\\w\]\+)\+\/'),
    ("Timing Attack", "medium", r'(?i)(?:==|eql\?|equal\?).*(?:password|token|secret|digest)'),
)
RUST = (
    ("Use of Unsafe", "medium", r'unsafe\s+\{'),
    ("Use of Unsafe", "medium", r'unsafe\s+fn\s+\w+'),
    ("Use of Unsafe", "medium", r'unsafe\s+trait\s+\w+'),
    ("Transmute Use", "high", r'std::mem::transmute'),
    ("Raw Pointer Operations", "high", r'std::ptr::(read|write|copy|copy_nonoverlapping)'),
    ("Raw Pointer Cast", "medium", r'as\s+\*(?:mut|const)\s+\w+'),
    ("Memory Leak", "medium", r'std::mem::forget'),
    ("Mutable Static", "high", r'static\s+mut\s+\w+'),
    ("Weak Memory Ordering", "medium", r'std::sync::atomic::\w+::new\([^)]+\).load\([^)]*Ordering::Relaxed[^)]*\)'),
    ("Exclusive Reference Risk", "medium", r'Arc::get_mut|Rc::get_mut'),
    ("Foreign Function Interface", "medium", r'extern\s+"C"\s+\{'),
    ("No Mangle FFI Export", "low", r'#\[no_mangle\]'),
    ("Unsafe C String Handling", "high", r'CString::from_vec_unchecked|CString::from_raw|CStr::from_ptr'),
    ("JSON Deserialization", "low", r'serde_json::from_str|serde_json::from_reader'),
    ("Deserialization Implementation", "low", r'serde::Deserialize'),
    ("Binary Deserialization", "medium", r'bincode::deserialize'),
    ("Unwrap Usage", "low", r'unwrap\(\)'),
    ("Expect Usage", "low", r'expect\([^\)]+\)'),
    ("Unsafe Unwrap", "high", r'unwrap_unchecked\(\)'),
    ("Use of Panic", "medium", r'panic!\s*\('),
    ("Use of Panic", "low", r'unwrap\(\)'),
    ("Use of Panic", "low", r'\.expect\('),
    ("Command Injection", "high", r'Command::new\s*\([^)]*\)\.arg\s*\([^)]*\+'),
    ("Command Injection", "high", r'Command::new\s*\([^)]*\)\.args\s*\([^)]*\+'),
    ("Command Injection", "high", r'Command::new\s*\([^)]*\+[^)]*\)'),
    ("Command Injection", "high", r'(?:Command|cmd).*\.arg\s*\(\s*format!'),
    ("Command Injection", "high", r'Command::new\("echo"\)\.arg\(format!'),
    ("SQL Injection", "critical", r'(?:query|execute|prepare)\s*\([\'"][^\'"]*[\'"] \+ '),
    ("SQL Injection", "critical", r'(?:query|execute|prepare)\s*\(format!\s*\([\'"][^\'"]*\{[^\}]*\}[^\'"]*[\'"]'),
    ("SQL Injection", "critical", r'(?:client|pool|conn)\.(?:query|execute)\s*\([\'"][^\'"]*[\'"] \+ '),
    ("SQL Injection", "critical", r'(?:client|pool|conn)\.query\s*\(\s*format!'),
    ("SQL Injection", "critical", r'client\.query\(format!'),
    ("Non-Cryptographic RNG", "medium", r'rand::thread_rng'),
    ("Weak Hash Function", "medium", r'md5::Md5|md5::compute'),
    ("Weak Hash Function", "medium", r'sha1::Sha1|sha1::compute'),
)
CSHARP = (
    ("SQL Injection", "critical", r'(?:ExecuteQuery|CommandText|SqlCommand).*?[\"\'].*?\+\s*(?:.*?)\s*(?:\+|$)'),
    ("SQL Injection", "critical", r'(?:using\s*\()?\s*new\s+SqlCommand\s*\(\s*.*?\s*\+'),
    ("SQL Injection", "high", r'string\s+sql\s*=.*?\+\s*.*?;'),
    ("SQL Injection", "critical", r'\.ExecuteSqlRaw\(.*?\+'),
    ("SQL Injection", "critical", r'\.FromSqlRaw\(.*?\+'),
    ("Command Injection", "critical", r'Process\.Start\s*\(\s*.*?\s*\+'),
    ("Command Injection", "critical", r'ProcessStartInfo.*?=.*?\+'),
    ("Command Injection", "high", r'(?:System\.Diagnostics\.)?Process\.Start\s*\(\s*(?:\"|\')(?:cmd|cmd.exe|powershell|bash|sh)(?:\"|\')'),
    ("XXE Vulnerability", "critical", r'new\s+XmlDocument\s*\(\s*\)\s*;.*?\.\s*Load\('),
    ("XXE Vulnerability", "high", r'XmlReaderSettings.*?XmlResolver\s*=\s*(?!null)'),
    ("XXE Vulnerability", "high", r'XmlTextReader(?!\s*\(\s*.*?\s*\)\s*{\s*DtdProcessing\s*=\s*DtdProcessing\.Prohibit)'),
    ("XXE Vulnerability", "medium", r'new\s+XmlSerializer\s*\('),
    ("Insecure Deserialization", "critical", r'BinaryFormatter.*?(?:Deserialize|Serialize)'),
    ("Insecure Deserialization", "critical", r'SoapFormatter.*?(?:Deserialize|Serialize)'),
    ("Insecure Deserialization", "critical", r'NetDataContractSerializer.*?(?:Deserialize|Serialize)'),
    ("Insecure Deserialization", "high", r'TypeNameHandling(?!.*None)'),
    ("Insecure Deserialization", "high", r'JsonSerializerSettings.*?TypeNameHandling(?!.*None)'),
    ("Path Traversal", "high", r'(?:File|Directory)\.(?:Open|Read|Write|Create|Delete)(?:Text)?.*?\+'),
    ("Path Traversal", "medium", r'(?:Path\.Combine\(|Path\.Join\().*?(?:\+|Request)'),
    ("Path Traversal", "high", r'(?:new FileStream|using.*?FileStream).*?\+'),
    ("Weak Randomness", "medium", r'new\s+Random\s*\('),
    ("Weak Randomness", "medium", r'(?:Math|System\.Math)\.Random\s*\('),
    ("Weak Cryptography", "high", r'(?:SHA1|MD5|DES|TripleDES|RC2)(?:CryptoServiceProvider|\.\s*Create)'),
    ("Weak Cryptography", "high", r'new\s+(?:SHA1|MD5)(?:Managed|CryptoServiceProvider)'),
    ("Weak Cryptography", "high", r'CipherMode\.(?:ECB|OFB|CFB|CTS)'),
    ("Weak Cryptography", "medium", r'PaddingMode\.(?:None|PKCS7|Zeros|ANSIX923)'),
    ("Insecure Authentication", "critical", r'RequireHttpsAttribute\s*=\s*false'),
    ("Insecure Authentication", "high", r'CookieAuthenticationOptions.*?(?:Secure\s*=\s*false|HttpOnly\s*=\s*false)'),
    ("Weak Key Protection", "medium", r'services\.AddDataProtection\(.*?\)(?!\s*\.ProtectKeysWithCertificate)'),
    ("Insecure Account Recovery", "medium", r'allowPasswordReset\s*:\s*false'),
    ("Weak Password Policy", "medium", r'options\.Password\.RequiredLength\s*=\s*(?:[1-7]\b)'),
    ("CSRF Vulnerability", "high", r'\[ValidateAntiForgeryToken\]\s*(?!\s*public\s+.*?Action)'),
    ("CSRF Vulnerability", "high", r'\.AddAntiforgery\(.*?\.SuppressXFrameOptionsHeader\s*=\s*true'),
    ("CSRF Vulnerability", "high", r'options\.Cookie\.SameSite\s*=\s*SameSiteMode\.None'),
    ("CSRF Vulnerability", "high", r'\[HttpPost\](?!\s*\[ValidateAntiForgeryToken\])'),
    ("Insecure Cookie", "high", r'(?:HttpCookie|Cookie).*?Secure\s*=\s*false'),
    ("Insecure Cookie", "high", r'(?:HttpCookie|Cookie).*?HttpOnly\s*=\s*false'),
    ("Insecure Cookie", "medium", r'new\s+CookieOptions\s*\(\s*\).*?(?!Secure\s*=\s*true)'),
    ("Insecure Cookie", "high", r'SameSiteMode\.None(?!\s*.*?Secure\s*=\s*true)'),
    ("Insecure Direct Object Reference", "medium", r'(?:Get|Find|Fetch|Load|Retrieve)(?:User|Account|Profile)\s*\(\s*(?:Request|id|userId)'),
    ("Insecure Direct Object Reference", "medium", r'\.(?:FirstOrDefault|Single)\s*\(\s*\w+\s*=>\s*\w+\.Id\s*==\s*(?:id|userId|Request)'),
    ("Sensitive Data Logging", "high", r'Log(?:ger)?\.(?:Error|Info|Debug|Warning|Critical|Log)\s*\(\s*.*?(?:password|token|key|secret|credentials|private)'),
    ("Sensitive Data Logging", "high", r'Console\.(?:WriteLine|Write)\s*\(\s*.*?(?:password|token|key|secret|credentials|private)'),
    ("Insecure Exception Logging", "medium", r'Log\.(?:Error|Info|Debug|Warning|Critical|Log)\s*\(\s*.*?Exception'),
    ("Open Redirect", "high", r'Redirect\s*\(\s*(?:.*?\+|Request\.Query|Request\.Form)'),
    ("Open Redirect", "high", r'Redirect(?:Result|ToRoute)?\s*\(\s*.*?(?:url|redirectUrl|returnUrl)(?:\s*\+|\[)'),
    ("Debugging Code", "low", r'#if\s+DEBUG'),
    ("Debugging Code", "medium", r'[Dd]eveloperExceptionPage\s*\('),
    ("Debugging Code", "medium", r'UseDeveloperExceptionPage\s*\(\s*\)'),
    ("Debugging Code", "low", r'Debugger\.(?:Break|Launch)'),
    ("Insecure CORS Configuration", "high", r'builder\.WithOrigins\s*\(\s*"\*"'),
    ("Insecure CORS Configuration", "critical", r'AllowAnyOrigin\s*\(\s*\).*?AllowCredentials\s*\(\s*true'),
    ("Insecure CORS Configuration", "high", r'app\.UseCors\s*\(\s*builder\s*=>\s*builder\.AllowAnyOrigin\s*\(\s*\)'),
    ("Missing Input Validation", "medium", r'Request\.Form\[\s*[\"\'].*?[\"\']\s*\](?!\s*\.(?:Validate|Sanitize|Contains))'),
    ("Missing Input Validation", "medium", r'Request\.QueryString\[\s*[\"\'].*?[\"\']\s*\](?!\s*\.(?:Validate|Sanitize|Contains))'),
    ("Unsafe Parsing", "low", r'(?:int|long|decimal)\.Parse\s*\(\s*(?!model\.)'),
    ("Server-Side Request Forgery", "high", r'new\s+HttpClient\(\).*?GetAsync\s*\(\s*.*?\+'),
    ("Server-Side Request Forgery", "high", r'using\s*\(\s*var\s+client\s*=\s*new\s+HttpClient\(\)\s*\).*?GetAsync\s*\(\s*.*?(?:url|uri|endpoint)(?:\s*\+|\[)'),
    ("Server-Side Request Forgery", "high", r'WebRequest\.Create\s*\(\s*.*?\+'),
    ("Incomplete Authentication", "medium", r'services\.AddAuthentication\s*\(.*?\)(?!\s*\.AddJwtBearer)'),
    ("Insecure JWT Configuration", "high", r'JwtBearerOptions.*?(?:ValidateIssuer\s*=\s*false|ValidateAudience\s*=\s*false|ValidateLifetime\s*=\s*false)'),
    ("Missing Authorization", "medium", r'builder\.Services\.AddRazorPages\(\)(?!\s*\.AddRazorPagesOptions\s*\(\s*options\s*=>\s*options\.Conventions\.AuthorizeFolder)'),
    ("Missing Authorization", "medium", r'AddControllers\(\)(?!\s*\.AddAuthorization)'),
    ("Unsafe Blazor Execution", "high", r'@\(\s*.*?\s*\)\s*=>\s*{.*?}\s*(?:eval|Function)'),
    ("Unsafe DOM Manipulation", "high", r'@\(\s*.*?\s*\)\s*=>\s*{.*?document\.write'),
    ("Client-Side Open Redirect", "medium", r'@\(\s*.*?\s*\)\s*=>\s*{.*?window\.location\s*='),
    ("Singleton Injection Risk", "low", r'services\.AddSingleton<.*?>(?:\(.*?\){.*?}|\(.*?new\s+(?!HttpClient\())'),
    ("Insecure HttpClient", "low", r'services\.AddHttpClient\s*\(.*?\)(?!\s*\.ConfigurePrimaryHttpMessageHandler)'),
    ("Connection String Injection", "high", r'services\.AddDbContext.*?optionsBuilder\.UseSqlServer\s*\(\s*.*?\+'),
    ("Insecure File Upload", "high", r'IFormFile.*?SaveAs\s*\(\s*.*?\+'),
    ("Path Traversal", "high", r'PhysicalFileProvider\s*\(\s*.*?\+'),
    ("MIME Type Sniffing", "medium", r'(?:\.UseStaticFiles|\.UseStaticWebAssets)\s*\(\s*\)(?!\s*\.Use(?:StaticFiles|StaticWebAssets)\s*\(\s*new\s+StaticFileOptions\s*{.*?ContentTypeProvider)'),
    ("Exposed Health Checks", "low", r'AddHealthChecks\s*\(\s*\).*?MapHealthChecks\s*\(\s*.*?\)(?!\s*\.RequireAuthorization)'),
    ("Cached Health Checks", "low", r'MapHealthChecks\s*\(\s*.*?new\s+HealthCheckOptions\s*{.*?AllowCachingResponses\s*=\s*true'),
)

BY_LANGUAGE = {"python": PYTHON, "javascript": JAVASCRIPT, "java": JAVA, "php": PHP, "go": GO, "ruby": RUBY, "rust": RUST, "csharp": CSHARP}
