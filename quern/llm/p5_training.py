"""The invented labelled texts that the credential model is fitted on: families of ways to write a secret down, and of what only looks like one.

Nothing here is taken from a corpus: names, values and the words around them are drawn at random, and what is a credential
stands between \\x01 and \\x02. A family is one way of writing; families can be left out, to measure on ways never seen.
"""

from __future__ import annotations

import base64
import random
import string
from collections.abc import Callable

ALNUM = string.ascii_letters + string.digits
SYLLABLES = "ba co di fu ga lo mi ne pa ro su ta ve wi xo ze bri cla dro fle gra pla sto tri".split()
#: Words of ordinary sentences.
FILLER = "the a to for now until we this it here in on of our before after only still please and with when still not use see keep from box host job next week".split()
NOUNS = "password passphrase pass pwd pw secret passcode token login credential".split()


class Invent:
    """Random names, values and surroundings."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.pick = rng.choice

    def word(self) -> str:
        return "".join(self.pick(SYLLABLES) for _ in range(self.rng.randint(2, 3)))

    def n(self, a: int, b: int) -> int:
        return self.rng.randint(a, b)

    def some(self, k: int, chars: str = ALNUM) -> str:
        return "".join(self.pick(chars) for _ in range(k))

    def hexa(self, k: int) -> str:
        return self.some(k, "0123456789abcdef")

    def camel(self) -> str:
        return self.word() + self.word().title()

    def prose(self, a: int = 1, b: int = 5) -> str:
        return " ".join(self.pick(FILLER) if self.rng.random() < 0.6 else self.word() for _ in range(self.n(a, b)))

    def remark(self, a: int = 3, b: int = 9) -> str:
        """A sentence as people and tools write it: capitals, marks, versions, numbers, names of things."""
        w = self.word
        part = lambda: self.pick([w, w, lambda: self.pick(FILLER), lambda: self.pick(FILLER), lambda: w().title(), lambda: w().upper(), lambda: w().upper() + "!", lambda: w() + self.pick(",.;:!?"), self.camel, lambda: f"{w()}_{w()}", lambda: f"{w()}-{w()}", lambda: f"v{self.n(1, 9)}.{self.n(0, 30)}.{self.n(0, 9)}", lambda: str(self.n(1, 2030)), lambda: f"{w()}.{self.pick(['js', 'py', 'md'])}", lambda: f"{w()}{self.n(1, 99)}", lambda: self.pick(NOUNS)])()
        return " ".join(part() for _ in range(self.n(a, b)))

    def user(self) -> str:
        return self.pick([self.word()[:4], self.word(), "root", "admin", "svc_" + self.word(), "app-" + self.word(), "deploy"])

    def host(self) -> str:
        return self.pick([f"{self.word()}-{self.n(1, 40)}.{self.word()}.example", f"{self.word()}.example", f"10.{self.n(0, 255)}.{self.n(0, 255)}.{self.n(1, 254)}", "localhost"])

    def password(self) -> str:
        a, b, c, s = self.word(), self.word(), self.word(), self.pick("-._#!?*$%+")
        return self.pick(
            [
                f"{a}{self.n(10, 2030)}", f"{a.title()}{self.n(10, 9999)}", f"{a}{s}{b.title()}{self.n(10, 9999)}", f"{a.title()}{s}{b}{self.n(10, 9999)}", f"{a}{s}{b}{self.n(10, 9999)}",
                f"{self.n(10, 99)}{a}{s}{b.title()}{s}{c}", f"{self.n(10, 99)}{a.title()}{s}{b}{s}{c}", f"{a}{b.title()}{c}", f"{a.title()}{b}{c}", f"{a}{b}{c.title()}", f"{a.title()}{b}{s}{c}", f"{a}{b.title()}{s}{c}",
                f"{a}{b}{s}{c.title()}", f"{a.title()}{s}{b}{s}{c}", self.some(self.n(10, 16)), self.some(self.n(9, 16), ALNUM + "#!?*$%+_"),
            ]
        )

    def vendor(self) -> str:
        mark = self.pick(["ghx", "npq", "zbk", "sk", "tk", "rk", "pat", "hkb", "dkr"]) + self.pick(["_", "-", ".", "_live_", "_prod_", "_test_"])
        return self.pick([mark + self.some(self.n(20, 40)), mark + self.some(self.n(20, 40)), "AIza" + self.some(35, ALNUM + "_-"), f"SG.{self.some(22)}.{self.some(43)}", f"{self.n(10**8, 10**10 - 1)}:{self.some(35, ALNUM + '_-')}"])

    def jwt(self) -> str:
        return f"eyJ{self.some(20)}.eyJ{self.some(40)}.{self.some(43, ALNUM + '_-')}"

    def key(self) -> str:
        return self.pick([lambda: self.some(self.n(20, 44)), lambda: self.some(self.n(20, 64), ALNUM + "_-"), lambda: self.some(40, ALNUM + "+/"), lambda: self.hexa(self.pick([32, 48, 64])), self.vendor, self.jwt])()

    def digest(self) -> str:
        return self.pick([lambda: self.hexa(40), lambda: self.hexa(64), lambda: "sha512-" + self.some(86, ALNUM + "+/") + "==", lambda: f"{self.hexa(8)}-{self.hexa(4)}-{self.hexa(4)}-{self.hexa(4)}-{self.hexa(12)}", lambda: "sha256:" + self.hexa(64)])()

    def hole(self) -> str:
        up = self.word().upper()
        return self.pick(["<your-token>", "<redacted>", "<password>", "********", "*****", "${" + up + "_PASSWORD}", "$" + up + "_TOKEN", "{{ vault.token }}", "{{ .Values.password }}", "REPLACE_ME", "xxxxxxxxxxxxxxxxxxxx", "changeme", "", "%(secret)s", "your-api-key", "TODO", "...", "null", "$(cat /run/secrets/token)", "YOUR_API_KEY_HERE"])

    def b64(self, s: str) -> str:
        return base64.b64encode(s.encode()).decode()

    def lead(self) -> str:
        return self.pick(["# ", "// ", "<!-- ", "  // ", "-- ", "/* ", " * ", "; ", "", "- ", "$ "])

    def name(self, words: list[str]) -> str:
        parts = [*([self.word()] if self.rng.random() < 0.5 else []), *self.pick(words).split(), *([self.pick(["old", "v2", "prod", "admin", "root", "test"])] if self.rng.random() < 0.25 else [])]
        style = self.pick("snake snake camel upper kebab dot".split())
        if style == "camel":
            return parts[0] + "".join(p.title() for p in parts[1:])
        return {"snake": "_", "upper": "_", "kebab": "-", "dot": "."}[style].join(parts).upper() if style == "upper" else {"snake": "_", "kebab": "-", "dot": "."}[style].join(parts)

    def assign(self, name: str, v: str) -> str:
        """name = v in some language; v may hold marks."""
        q, tab = self.pick("\"'"), self.pick(["", "  ", "    ", "\t"])
        bare = self.rng.random() < 0.5
        return tab + self.pick(
            [
                f"{name} = {q}{v}{q}", f"{name} = {q}{v}{q}", f"{name}={q}{v}{q}", f"const {name}: string = {q}{v}{q};", f"let {name} = {q}{v}{q};", f"var {name} = {q}{v}{q}", f"this.{name} = {q}{v}{q};", f"{self.word()}[{q}{name}{q}] = {q}{v}{q}",
                f'private static final String {name} = "{v}";', f'public const string {name} = "{v}";', f'pub static {name.upper()}: &str = "{v}";', f"{name} := {q}{v}{q}", f"val {name} = {q}{v}{q}", f'let {name}: String = "{v}"',
                f"${name} = {q}{v}{q};", f'#define {name.upper()} "{v}"', f'"{name}": "{v}",', f'"{name}" : "{v}"', f"{name}: {v}" if bare else f"{name}: {q}{v}{q}", f"{name}: {q}{v}{q},", f"{name}={v}", f"{name} = {v}",
                f"export {name.upper()}={q}{v}{q}", f"export {name.upper()}={v}", f'static const char *{name} = "{v}";', f"{name} => {q}{v}{q},", f":{name} => {q}{v}{q}", f"{name} <- {q}{v}{q}", f"local {name} = {q}{v}{q}", f"set {name}={v}",
                f"- {name.upper()}={v}", f"<{name}>{v}</{name}>", f'<add key="{name}" value="{v}" />', f'<property name="{name}" value="{v}"/>', f"| {name} | {v} |", f"{self.prose(0, 3)} `{name}={v}` {self.prose(0, 3)}", f'default = "{v}" # {name}' if bare else f'{name} = "{v}"',
            ]
        )


PASS_WORDS = ["password", "passwd", "pwd", "pass", "pw", "db pw", "passphrase", "passwort", "clave", "login pass", "root credential", "secret", "credential", "auth", "userpassword", "dbpassword"]
KEY_WORDS = "apikey,api key,access key,secret access key,account key,master key,encryption key,client secret,hook secret,hmac secret,storage secret,token,tok,deploy tok,auth token,bearer,auth,secret key,signing key,license secret,credential,seed,private seed,refresh key,salt key,session jwt,webhook secret,authtoken".split(",")
ABOUT = "password field,password label,password hint,token help,token type,secret name,api key header,key name,max tokens,password length,credential id,auth header,token url,secret path,token count,auth type,tokenizer,password policy".split(",")
PLAIN = "name,mode,label,region,title,path,level,header,build ref,expected digest,checksum,commit,trace,version,theme,pattern,integrity,lock,sha256,public key,request id,key,sort key,cache key,tenant id,etag".split(",")


def S(v: str) -> str:  # noqa: N802
    return f"\x01{v}\x02"


def _command(v: Invent) -> str:
    p, u, h = S(v.password()), v.user(), v.host()
    return v.lead() + v.pick(
        [
            f"{v.pick(['mysql', 'mysqldump', 'mysqladmin', 'mariadb'])} -u{v.pick(['', ' '])}{u} -p{p} {v.word()}", f"mysql -h {h} -u {u} -p{p}", f"mysqldump -p{p} -u{u} {v.word()} > {v.word()}.sql",
            f"sshpass -p {v.pick([p, chr(39) + p + chr(39)])} {v.pick(['ssh', 'scp', 'rsync'])} {u}@{h}", f"docker login -u {u} -p {p} {h}", f"helm registry login {h} -u {u} -p {p}", f"redis-cli -h {h} -a {p}", f"sqlcmd -S {h} -U {u} -P {p}",
            f"ldapsearch -D cn={u} -w {p}", f"unzip -P {p} {v.word()}.zip", f"mongosh --host {h} -u {u} -p {p}", f"htpasswd -b {v.word()}.txt {u} {p}", f"openssl enc -aes-256-cbc -k {p}", f"openssl rsa -passin pass:{p} -in {v.word()}.pem", f"keytool -storepass {p} -alias {v.word()}",
        ]
    )


def _flags(v: Invent) -> str:
    flag = v.pick(["--password", "--passwd", "--token", "--secret", "--api-key", "--client-secret", "--auth-token", "--db-password", "--pass"])
    value = S(v.pick([v.password, v.key])())
    return f"{v.lead()}{v.word()}{v.pick(['ctl', '', '-cli'])} {v.pick(['login ', 'push ', '', 'auth '])}{v.pick(['', f'--user {v.user()} ', f'-u {v.user()} '])}{flag}{v.pick([' ', '='])}{value}{v.pick(['', ' --' + v.word(), ' ' + v.word()])}"


def _curl(v: Invent) -> str:
    return v.lead() + v.pick(
        [
            f"curl {v.pick(['', '-s '])}-u {v.user()}:{S(v.password())} https://{v.host()}/", f"curl --user {v.user()}:{S(v.password())} https://{v.host()}/{v.word()}", f'curl -H "Authorization: Bearer {S(v.key().replace(':', '_'))}" https://{v.host()}/v1/{v.word()}',
            f"curl -H 'X-Api-Key: {S(v.key())}' https://{v.host()}/{v.word()}", f'curl -H "Authorization: Basic {S(v.b64(v.word() + ":" + v.password()))}" https://{v.host()}', f"http -a {v.user()}:{S(v.password())} {v.host()}/{v.word()}", f"wget --http-password={S(v.password())} https://{v.host()}/{v.word()}",
        ]
    )


def _sentence(v: Invent) -> str:
    noun = v.pick(NOUNS)
    return f"{v.lead()}{v.prose(0, 5)} {v.pick(['', v.word() + ' ', 'root ', 'admin ', 'old '])}{noun}{v.pick([' is ', ' is still ', ' = ', ': ', ' was ', ' now ', ' set to ', '=', ' -> ', ' for ' + v.word() + ' is ', ', currently '])}{S(v.password())}{v.pick(['', ' ' + v.prose(1, 4)])}"


def _pair(v: Invent) -> str:
    noun = v.pick(["login", "credentials", "account", "creds", "sign in", "user/password", "credentials", "login"])
    return f"{v.lead()}{v.prose(0, 3)} {noun}{v.pick([' ', ': ', ' for the ' + v.word() + ' ' + v.word() + ': ', ' of ' + v.word() + ' '])}{v.user()}{v.pick([' / ', ':', '/ ', ' : '])}{S(v.password())}{v.pick(['', ' ' + v.prose(1, 4)])}"


def _env(v: Invent) -> str:
    name = v.pick([v.word().upper() + "_", "", "DB_", "APP_"]) + v.pick("TOKEN PASSWORD SECRET PW PASS API_KEY AUTH_TOKEN ACCESS_KEY ROOT_PASSWORD".split())
    value = S(v.pick([v.password(), v.some(22), v.key()]))
    return v.pick(
        [
            f"{v.lead()}docker run {v.pick(['', '--rm ', '-d '])}-e {name}={value} {v.word()}:{v.pick(['latest', '1.2'])}", f"{v.lead()}ENV {name}={value}", f"{v.lead()}ENV {name} {value}", f"ARG {name}={value}", f"{v.lead()}{name}={value} {v.word()} --{v.word()}", f"{v.lead()}export {name}={value}; {v.word()}",
            f"PGPASSWORD={S(v.password())} psql -h {v.host()} -U {v.user()}", f"setx {name} {value}", f"      - {name}={value}", f"    - name: {name}\n      value: {value}", f'    - name: {name}\n      value: "{value}"', f"heroku config:set {name}={value}", f"java -D{v.word()}.password={value} -jar {v.word()}.jar", f"helm install {v.word()} --set {v.word()}.password={value}",
        ]
    )


def _call(v: Invent) -> str:
    p, u, q = S(v.password()), v.user(), v.pick("\"'")
    kw = v.pick(["password", "passwd", "secret", "pwd", "pass"])
    return v.pick(
        [
            f"{v.word()} = {v.pick(['connect', 'create_engine', v.camel(), 'Client', 'open_session'])}({q}{v.host()}{q}, user={q}{u}{q}, {kw}={q}{p}{q})", f"{v.word()}.{v.pick(['login', 'connect', 'authenticate', 'signIn', 'basicAuth'])}({q}{u}{q}, {q}{p}{q}){v.pick([';', ''])}", f"{v.word()} = {v.pick(['HTTPBasicAuth', 'PasswordCredential', 'NetworkCredential'])}({q}{u}{q}, {q}{p}{q})",
            f"requests.get(url, auth=({q}{u}{q}, {q}{p}{q}))", f'{v.word()}.put("{v.word()}.{kw}", "{p}");', f'{v.word()}.{v.pick(["setProperty", "set", "put", "Add"])}("{kw}", "{p}");', f'{v.word()}.set{v.pick(["Password", "Secret", "ApiKey", "Token"])}("{S(v.pick([v.password, v.key])())}");',
            f"new {v.word().title()}Client({{ apiKey: {q}{S(v.key())}{q}, region: {q}{v.word()}{q} }})", f"{v.word()}({{user: {q}{u}{q}, {kw}: {q}{p}{q}}})", f'{v.word()}.Headers.Add("Authorization", "Bearer {S(v.key().replace(':', '_'))}");', f'DriverManager.getConnection(url, "{u}", "{p}")',
        ]
    )


def _config(v: Invent) -> str:
    p = S(v.password())
    return v.pick(
        [
            f"machine {v.host()} login {v.user()} password {p}", f"  login {v.user()}\n  password {p}", f"requirepass {p}", f"masterauth {p}", f"//{v.host()}/:_authToken={S(v.key())}", f"_password={S(v.some(24))}", f"<password>{p}</password>", f"    <{v.word()}Password>{p}</{v.word()}Password>", f'<user name="{v.user()}" password="{p}" roles="{v.word()}"/>',
            f"CREATE USER {v.user()} WITH PASSWORD '{p}';", f"CREATE USER '{v.user()}'@'%' IDENTIFIED BY '{p}';", f"ALTER USER {v.user()} PASSWORD '{p}';", f'{v.word()}_password = """\n{p}\n"""', f"password: |\n  {p}", f"{v.word()}_secret: >-\n    {S(v.key())}", f"{v.name(PASS_WORDS)} = \\\n    '{p}'", f"const {v.camel()}Password =\n  '{p}';",
            f"dsn: {v.user()}:{p}@tcp({v.host()}:3306)/{v.word()}", f'spring.datasource.password={p}', f"net use z: {chr(92) * 2}{v.word()}{chr(92)}{v.word()} /user:{v.user()} password:{p}",
        ]
    )


def _markup(v: Invent) -> str:
    name, p = v.name(PASS_WORDS), S(v.pick([v.password, v.password, v.key])())
    return v.pick(["", "  ", "    "]) + v.pick([f"<{name}>{p}</{name}>", f'<add key="{name}" value="{p}" />', f'<property name="{name}" value="{p}"/>', f'<entry key="{name}">{p}</entry>', f'<param name="{name}" value="{p}">', f'<user name="{v.user()}" password="{p}"/>', f'<setting {name}="{p}" mode="{v.word()}"/>', f"- name: {name}\n  value: {p}", f'{{"name": "{name}", "value": "{p}"}},'])


def _hook(v: Invent) -> str:
    url = v.pick(
        [
            f"https://hooks.{v.host()}/{v.pick(['services', 'workflows', v.word()])}/{v.pick(['T', 'B', ''])}{v.some(9, string.ascii_uppercase + string.digits)}/{S(v.some(v.n(20, 26)))}", f"https://{v.host()}/{v.pick(['api/webhooks', 'webhook', 'hooks'])}/{v.n(10**8, 10**9)}/{S(v.some(v.n(24, 60), ALNUM + '_-'))}",
            f"https://api.{v.word()}.example/{S('bot' + str(v.n(10**8, 10**9)) + '-' + v.some(35, ALNUM + '_-'))}/send", f"https://{v.host()}/{v.word()}?{v.pick(['access_token', 'api_key', 'token', 'sig', 'secret', 'apikey'])}={S(v.key())}", f"https://{v.host()}/{v.word()}?{v.word()}={v.n(1, 99)}&{v.pick(['access_token', 'key', 'auth', 'password'])}={S(v.some(32))}",
        ]
    )
    return v.pick([v.assign(v.pick([v.word() + "_hook", v.word() + "Url", "webhook", "endpoint", v.word() + "_callback"]), url), f"{v.lead()}{v.prose(0, 4)} {url}", f"{v.lead()}curl -X POST {url}"])


def _pem(v: Invent) -> str:
    lead = v.pick(["", "", "  ", "# ", "// ", "    "])
    kind = v.pick(["RSA ", "EC ", "OPENSSH ", "ENCRYPTED ", "DSA ", ""])
    head = v.pick(["", "", f"{lead}Proc-Type: 4,ENCRYPTED\n{lead}DEK-Info: AES-128-CBC,{v.hexa(32).upper()}\n{lead}\n"])
    body = "\n".join(lead + v.some(64, ALNUM + "+/") for _ in range(v.n(2, 6)))
    if v.rng.random() < 0.2:
        return f"\x01-----BEGIN PGP PRIVATE KEY BLOCK-----\n{v.pick(['', 'Version: 1.4' + chr(10)])}\n{body}\n={v.some(4)}\x02\n-----END PGP PRIVATE KEY BLOCK-----"
    return f"{lead}\x01-----BEGIN {kind}PRIVATE KEY-----\n{head}{body}\x02\n{lead}-----END {kind}PRIVATE KEY-----"


def _pem_line(v: Invent) -> str:
    kind, line = v.pick(["RSA ", "OPENSSH ", "EC ", ""]), "\\n"
    return v.assign(v.pick([v.word(), "key", "pem", "private_key"]), S(f"-----BEGIN {kind}PRIVATE KEY-----{line}{v.some(64)}{line}{v.some(64)}{line}-----END {kind}PRIVATE KEY-----"))


def _public_pem(v: Invent) -> str:
    lead, kind = v.pick(["", "  ", "# ", "// "]), v.pick(["PUBLIC KEY", "CERTIFICATE", "RSA PUBLIC KEY", "CERTIFICATE REQUEST", "PGP PUBLIC KEY BLOCK", "PGP SIGNATURE"])
    return v.pick([f"{lead}-----BEGIN {kind}-----\n" + "\n".join(lead + v.some(64, ALNUM + "+/") for _ in range(v.n(2, 6))) + f"\n{lead}-----END {kind}-----", v.assign(v.pick(["cert", "pub", v.word()]), f"-----BEGIN {kind}-----\\n{v.some(64)}\\n-----END {kind}-----")])


SCHEMES = ["postgres", "postgresql", "mysql+pool", "mysql", "mongodb", "mongodb+srv", "amqp", "redis", "https", "ftp", "smtp"]

#: Ways to write a secret down.
POSITIVE: dict[str, Callable[[Invent], str]] = {
    "assigned password": lambda v: v.assign(v.name(PASS_WORDS), S(v.password())),
    "assigned key": lambda v: v.assign(v.name(KEY_WORDS), S(v.key())),
    "split key": lambda v: f"{v.name(KEY_WORDS)} = {(q := v.pick(chr(34) + chr(39)))}{S(v.some(v.n(14, 24)))}{q} {v.pick('+.')} {q}{S(v.some(v.n(14, 24)))}{q}{v.pick(['', ';'])}",
    "vendor key anywhere": lambda v: v.assign(v.name([*PLAIN[:8], v.word()]), S(v.pick([v.vendor, v.jwt])())),
    "basic header": lambda v: v.assign(v.pick(["authorization", "header", "auth_header_value", "proxy-authorization", v.word()]), f"Basic {S(v.b64(v.word() + ':' + v.password()))}"),
    "bearer header": lambda v: v.assign(v.pick(["authorization", "header", "Authorization", v.word()]), f"{v.pick(['Bearer', 'Bearer', 'token', 'Token'])} {S(v.key().replace(':', '_'))}"),
    "encoded account": lambda v: v.assign(v.pick(["registry_auth", "auth", "dockercfg", v.word()]), S(v.b64('{"user": "' + v.word() + '", "password": "' + v.password() + '"}'))),
    "connection string": lambda v: v.assign(v.pick(["dsn", "connection", v.word() + "_dsn", "store", "ConnectionString"]), f"{v.pick(['Server', 'Data Source', 'Host'])}={v.host()};{v.pick(['Database', 'Initial Catalog'])}={v.word()};{v.pick(['User Id', 'Uid', 'User'])}={v.user()};{v.pick(['Pwd', 'Password'])}={S(v.password())}{v.pick([';', '', ';Encrypt=true;'])}"),
    "address with password": lambda v: v.pick([v.assign(v.pick([v.word() + "Uri", v.word() + "_url", v.word() + "Endpoint", "dsn", "origin"]), url := f"{v.pick(SCHEMES)}://{v.user()}:{S(v.password())}@{v.host()}:{v.n(1000, 9999)}/{v.word()}"), f"{v.lead()}{v.prose(0, 3)} {url}", f"{v.lead()}git clone {url}"]),
    "command": _command,
    "flags": _flags,
    "curl": _curl,
    "sentence": _sentence,
    "pair": _pair,
    "environment": _env,
    "call": _call,
    "configuration": _config,
    "markup": _markup,
    "hook": _hook,
    "key block": _pem,
    "key in a line": _pem_line,
}


def _said(v: Invent) -> str:
    """A sentence that speaks of a secret and holds none."""
    noun = v.pick([*NOUNS, "api_key", "credentials", "bearer token", "secret key"])
    return v.lead() + v.pick(
        [
            f"{v.prose(0, 3)} {noun} {v.pick(['is read from', 'comes from', 'is checked by', 'is kept in', 'must not be', 'is stored in', 'is used by', 'of'])} {v.pick(['the vault', 'the ' + v.word(), v.camel(), v.word() + '.' + v.word(), 'process start'])}", f"never {v.pick(['log', 'print', 'commit'])} the {noun} or the {v.pick(NOUNS)}", f"rotate the {noun} {v.prose(1, 4)}", f"{v.prose(1, 4)} {noun} {v.prose(1, 4)}",
            f"Authorization: {v.pick(['Bearer', 'Basic'])} {v.pick(['<token>', '$TOKEN', '{token}', '...'])}", f"{noun}: {v.pick(['required', 'optional', 'string', 'see below', 'never logged', 'hashed'])}", f"{noun} is {v.pick(['required', 'missing', 'invalid', 'expired', 'wrong', 'empty', 'rotated', 'not set'])}", f"curl -u $USER:$PASSWORD https://{v.host()}/", f"{v.word()}ctl login --user {v.user()} --password {v.pick(['$PASSWORD', '<password>', '-stdin', '********'])}",
            f"mysql -u {v.user()} -p {v.word()}", f"mysqldump -u{v.user()} -p{v.pick(['', '$DB_PASSWORD', '<password>'])} {v.word()}", f"sshpass -p $SSH_PASSWORD ssh {v.user()}@{v.host()}", f"docker login -u {v.user()} --password-stdin", f"mkdir -p {v.word()}/{v.word()}{v.n(1, 99)}", f"ssh -p {v.n(1000, 9999)} {v.user()}@{v.host()}", f"cp -pr {v.word()} {v.word()}", f"find . -path ./{v.word()}{v.n(1, 9)} -print", f"docker run -p {v.n(1000, 9999)}:{v.n(1000, 9999)} {v.word()}", f"login as {v.user()} / {v.prose(1, 2)}", f"tar -pxzf {v.word()}{v.n(1, 9)}.tgz",
            f"nmap -p{v.n(1000, 9999)} {v.host()}", f"docker run -e {v.word().upper()}_TOKEN=${v.word().upper()}_TOKEN {v.word()}", f"machine-{v.word()} by {v.word()} at build {v.n(1, 99)}", f"see https://{v.host()}/{v.word()}/{v.word()}-{v.n(1, 99)} for the {noun}", f"account {v.word()} / {v.word()} {v.prose(0, 3)}",
        ]
    )


def _code(v: Invent) -> str:
    w, c, k = v.word, v.camel, lambda: v.n(1, 999)
    thing = v.pick(["token", "Token", "password", "secret", "key", w(), "login", "auth"])
    t = thing.title()
    return v.pick(
        [
            f"def {w()}_{thing}({w()}, {w()}={k()}):", f"    {w()}_{thing} = {w().title()}{w().title()}({k()})", f"    if {w()}.{thing} > {k()}:", f"  private {w()}{t} = new Map<string, number>();", f"      throw new Error(`{w()} {w()} {thing}: ${{{c()}}}`);", f"    expect({w()}.{thing}).toBe({k()});", f'  logger.warn("{w()} {w()} {thing}", {{ {c()}, retries: {k()} }});',
            f'  {thing}{k()}: {{ wireType: {v.n(0, 5)}, id: {k()}, path: "/{w()}/{thing}/{k()}" }},', f"public static final int {w().upper()}_{k()}_FIELD_NUMBER = {k()};", f"  integrity sha512-{v.some(86, ALNUM + '+/')}==", f'  "{v.some(76, ALNUM + "+/")}" +', f'  "{v.some(76, ALNUM + "+/")}"', f"  0x{v.hexa(2)}, 0x{v.hexa(2)}, 0x{v.hexa(2)}, 0x{v.hexa(2)}, 0x{v.hexa(2)}, 0x{v.hexa(2)},",
            f"import {{ {c()} }} from '../{w()}/{w()}-{v.n(1, 9)}';", f"func (m *{w().title()}) Get{w().title()}{k()}() int32 {{", f'    "{thing}": {k()},', f'    "{thing}": [{k()}, {k()}]', f'    "{thing}": {{', f"{w()}.{w()}_{w()}.limit={k()}", f"{w()}.{thing}.every={k()}", f'client.send("{w()}", "{w()}{k()}");', f'{w()} = connect("{v.host()}", user="{w()}", timeout={k()})', f"const {c()}: {w().title()}{t}[] = {w()}.filter(({w()}) => {w()}.{w()} > {c()});",
            f'this.{(n := w() + str(k()))}.Name = "{n}";', f"this.{thing}{(n := k())}.TabIndex = {n};", f".{w()}-{k()}{{margin:{k()}px;color:#{v.hexa(6)}}}.{thing}-{k()}{{margin:{k()}px;color:#{v.hexa(6)}}}", f"        for ({w().title()}{t} item : {w()}{t}) {{", f"\t{w()}{t} time.Duration", f"const {thing} = use{w().title()}(() => {c()}({c()}, {k()}), [{c()}]);", f"    this.{(n := thing + w().title())} = {n};", f"  {thing}: {c()}{v.pick([',', ';', '()'])}", f"  {thing}: {v.pick(['string', 'str', 'String', 'Option<String>', 'number | null'])}{v.pick([';', ',', ''])}",
            f"public sealed class {w().title()}{t} : I{w().title()}{t}", f"  return {w()}.reduce((sum, n) => sum + n, {w()}{t} || 0);", f"class {w().title()}{w().title()} extends Base{thing} {{", f"{w()}({w()}.{thing}, {c()})", f"std::vector<int> {c()}(const std::vector<int>& {w()}{t}, int {c()}) {{", f"    {w()}_{thing}.append({w()})", f"if (!{thing}{w().title()}.length) {{", f"@{w()}_{thing} = {w()}_{thing}", f"attr_reader :{thing}", f"const {c()} = await {w()}.{c()}(\"{thing}\");", f"_{w().upper()}_{k()} = _descriptor.field(name='{thing}_{k()}', number={k()}, type={v.n(0, 9)}, label=1)",
            f'{{"id": {k()}, "name": "{w()} {thing}", "lat": {k()}.{k()}, "lon": {k()}.{k()}}},', f'raise ArgumentError, "{w()} {thing} {w()}" if {w()}.nil?', f'{w()}.select {{ |{thing}| {thing}.{w()} > {c()} }}.first({k()})', f"let {thing} = self.{w()}.get({c()});", f"Some({thing}) => Ok(*{thing} + {k()}),", f'"{w()}{t}": {k()},', f'{{"name": "{w()}", "value": "{w()}-{k()}"}},', f'<param name="{thing}_{v.pick(["type", "length", "mode"])}" value="{w()}">', f"{w()}: {w()}_{k()}", f"{w()}_secret:\n  {w()}: {k()}", f"{w()}_{thing}:\n  name: {w()}-{w()}\n  key: {w()}", f"{thing}:\n  - {w()}\n  - {w()}", f"- name: {w()}\n  value: {w()}-{k()}", f"- name: {w().upper()}_PASSWORD\n  valueFrom:\n    secretKeyRef: {w()}",
            f'assertEquals("{thing}", "{w()}{k()}")', f'{w()}.put("{w()}", "{w()}-{k()}");', f'map.put("{thing}_type", "{w()}");', f'log.info("{thing}", "{w()}")', f'<label for="{thing}">{w().title()}</label>', f'<input type="{thing}" name="{thing}" value="{v.pick(["", w()])}"/>', f"<{w()}>{w()} {w()}</{w()}>", f'<add key="{w()}" value="{w()}-{k()}" />', f"| {thing} | {v.prose(1, 5)} |", f"| {w()} | {w()}-{k()} |", f"  - `{c()}{t}` {v.prose(3, 8)}", f"{v.prose(4, 10)} See `{c()}` for the {w()} case and `{c()}{t}` for the limits ({k()} to {k()}).", f"{w()} = {w()} * {k()} + {w()}",
        ]
    )


def _statement(v: Invent) -> str:
    """Statements of any language, in which names that speak of secrets come like others."""
    w, c, k = v.word, v.camel, lambda: v.n(1, 999)
    a, b, d = (v.pick([w, c, lambda: f"{w()}_{w()}", lambda: v.pick(["token", "account", "login", "secret", "key", "pass", "auth"]) + v.pick(["", str(v.n(1, 120)), w().title()]), lambda: f"{w()}.{c()}", lambda: f"{v.pick([w()[:1], w()])}.{v.pick([w().title(), w(), c(), c().title()])}{k()}", lambda: f"{v.pick([w(), c(), w().title(), w().upper()])}{v.pick(['', '_', '-', '.'])}{k()}"])() for _ in range(3))
    q = v.pick("\"'")
    return v.pick(["", "  ", "    ", "\t"]) + v.pick(
        [
            f"for {a}, {b} in {d}.items():", f"for _, {a} := range {b} {{", f"for ({a} of {b}) {{", f"for (let i = 0; i < {a}.length; i++) {{", f"while ({a} && {b}.size() < {k()}) {{", f"if ({a} == null || {b} > {k()}) return {d};", f"if {a} and len({b}) < {k()}:", f"return {a}", f"return {a};", f"return {a} + {b}", f"{a}", f"yield {a}, {b}", f"print({a}, {b})", f"return {a}.map(({b}) => {b}.{w()} ?? {k()});", f"raise {w().title()}Error({q}{w()} {w()} {w()}{q}) unless {a}",
            f"raise ArgumentError, {q}{w()} {w()} {v.pick(NOUNS)}{q} if {a}.{v.pick(['nil?', 'empty?', 'blank?'])}", f"throw new Error({q}{w()} {v.pick(NOUNS)} {w()}{q});", f"{a}.{w()}({b}, {d})", f"const {w()} = {a} ? {b} : {d};", f"{a} = {b} or {d}", f"{a} += {b} * {k()}", f"let mut {w()} = {a}.iter().filter(|{w()}| *{w()} > {k()}).take({k()});", f"self.{w()} = {a}", f"assert {a}[{q}{w()}{q}] == {k()}", f"expect({a}).toEqual({q}{w()}{k()}{q});",
            f"{a}.{v.pick(['Name', 'Text', 'Title', 'id'])} = {q}{v.pick([w(), 'account', 'login', 'token'])}{k()}{q};", f"this.{a} = new {w().title()}.{w().title()}();", f"public {w().title()} {c()}({w().title()} {w()}, int {c()}) {{", f"fn {w()}_{w()}(&mut self, {w()}: &str) -> Result<usize, String> {{", f"func (r *{w().title()}) {c()}(ctx context.Context) error {{", f"type {w().title()}{w().title()} struct {{", f"export interface {w().title()}{w().title()} {{", f"import {a}", f"from {w()}.{w()} import {c()}",
            f"#include <{w()}/{w()}.h>", f"using {w().title()}.{w().title()};", f"@{w().title()}", "});", "} else {", f"case {k()}: return {q}{w()}{q};", f"{w()}?: {w()};", f"|{a}| {b} + {k()}", f"{w()} << {a} << {q}{w()}{q}", f"echo {q}{w()} {w()}{q}", f"<div class={q}{w()}-{k()} {w()}{q}>{w()} {w()}</div>", f"SELECT {w()}, {w()} FROM {w()} WHERE {w()} = {k()};", f"describe({q}{w()} {w()}{q}, () => {{", f"it({q}{v.prose(3, 8)}{q}, async () => {{",
            f"/** {v.remark()} */", f"{q * 3}{v.remark()}.{q * 3}", f"# {v.remark()}", f"// {v.remark()}", f"<!-- {v.remark()} -->", f"- {v.remark()}", f"## {v.remark(2, 4)}", v.remark(6, 20), f"{v.remark(2, 5)}: {v.remark(2, 5)}",
        ]
    )


def _typed(v: Invent) -> str:
    """Names that speak of secrets, declared with a type or given another name."""
    name, other = v.name(PASS_WORDS + KEY_WORDS), v.pick([v.camel(), v.word(), f"{v.word()}_{v.word()}"])
    kind = v.pick("string str &str String Long? String? Option<String> number int Vec<u8> bytes SecretStr time.Duration char[] Array<string> []byte Token IToken uint64 boolean bool map[string]int".split() + [v.word().title() + v.word().title(), "I" + v.word().title() + "Token"])
    return v.pick(["", "  ", "    ", "\t"]) + v.pick(
        [
            f"{name}: {kind}", f"{name}: {kind};", f"{name}: {kind},", f"{name}?: {kind};", f"{name} {kind}", f"private {kind} {name};", f"def {v.word()}({name}: {kind}, {v.word()}: {kind}) -> {kind}:", f"data class {v.word().title()}(val {name}: {kind}, val {v.word()}: {kind})", f"fn {v.word()}(&mut self, {name}: &str) -> Result<usize, {kind}> {{", f"func {v.camel()}({name} {kind}) error {{",
            f"{v.word()}: Array<{kind} | null>;", f"{v.pick(['account', 'login', 'token'])}: Array<{kind} | null>;", f"this.{name} = {name};", f"self.{name} = {name}", f"this.{v.word()}Token = {other};", f"public sealed class {v.word().title()}Token : I{v.word().title()}Token", f"class {v.word().title()}Secret({kind}):", f"{name} = {other}", f"{name} := {other}", f"let {name} = {other}.{v.word()}();", f"{name}={other},", f"{v.word()}({name}={other})", f"return {name} == {other}",
        ]
    )


def _minified(v: Invent) -> str:
    x = lambda: v.pick(string.ascii_lowercase)
    w, k = v.word, lambda: v.n(0, 99)
    part = lambda: v.pick(
        [
            f'!function({x()}){{"use strict";{x()}.{w()}=function({x()}){{for(var {x()}=0;{x()}<{x()}.length;{x()}++){x()}[{x()}[{x()}]]=1}}}}({x()});', f"function {x()}({x()},{x()}){{return {x()}&&{x()}?{x()}.{w()}({x()}):void 0}}", f'if({x()}>{k()}e3)throw Error("{w()}");', f"var {x()}={x()}({k()}),{x()}=!{k()};", f"{x()}={x()}==null?{x()}:{x()}.{w()}||{{}};",
            f"{x()}.{w()}(({x()},{x()})=>{x()}?{x()}:[{k()},{k()}]),", f'{x()}.exports={{{w()}:{x()},{w()}:"{w()}{k()}"}};', f".{w()}-{k()}{{margin:{k()}px;color:#{v.hexa(6)}}}", f"@media(max-width:{k()}px){{.{w()}{{padding:{k()}px!important}}}}", f'{x()}.prototype.{w()}=function(){{return this.{w()}+"{v.pick(NOUNS)}"}};',
        ]
    )
    return "".join(part() for _ in range(v.n(1, 4)))


def _address(v: Invent) -> str:
    h, w = v.host(), v.word
    url = v.pick([f"https://{h}/{w()}?page={v.n(1, 99)}", f"https://{h}/{w()}/{w()}/{v.hexa(40)}", f"https://{v.user()}@{h}/{w()}?page={v.n(1, 99)}", f"https://{h}/{w()}/{w()}-{v.n(1, 99)}.js", f"https://{h}/token?page={v.n(1, 99)}", f"https://{h}/{w()}?token=${{TOKEN}}", f"https://{h}/hooks/{w()}/{v.n(1, 999)}", f"https://{h}/{w()}/{v.hexa(8)}-{v.hexa(4)}-{v.hexa(4)}-{v.hexa(4)}-{v.hexa(12)}", f"http://{h}:{v.n(1000, 9999)}/{w()}{w().title()}/{w()}", f"https://{h}/{w()}?id={v.some(11)}&key={w()}"])
    return v.pick([v.assign(v.pick([w() + "_url", w() + "Endpoint", w() + "_hook", "upstream"]), url), f"{v.lead()}{v.prose(0, 4)} {url}", f"{v.lead()}Copied from {w()} {v.n(1, 9)}.{v.n(1, 9)}, upstream {url}"])


#: Ways to write what is none.
NEGATIVE: dict[str, Callable[[Invent], str]] = {
    "about": lambda v: v.assign(v.name(ABOUT), v.pick(["bearer", "user_password", "x-api-key", f"prod/{v.word()}/db", v.word(), "Enter your password", "Forgot your passphrase?", "Password must have 12 characters", "Paste the token here", "wordpiece", v.word() + "-" + v.word(), str(v.n(10, 9999))])),
    "holes": lambda v: v.assign(v.name(PASS_WORDS + KEY_WORDS), v.hole()),
    "digests": lambda v: v.assign(v.name(PLAIN[8:]), v.digest()),
    "plain": lambda v: v.assign(v.name(PLAIN), v.pick([v.word(), v.prose(), f"{v.word()}/{v.word()}.py", v.camel(), f"{v.word()}-{v.n(1, 99)}", f"{v.word()}{v.n(1, 99)}", "data:image/png;base64," + v.some(100, ALNUM + "+/") + "="])),
    "trusted connection": lambda v: v.assign(v.pick(["dsn", "connection", "store"]), f"Server={v.host()};Database={v.word()};{v.pick(['Integrated Security=true', 'Trusted_Connection=yes', 'User Id=' + v.user()])};"),
    "read elsewhere": lambda v: v.pick([
        f'{v.name(PASS_WORDS)} = os.environ["{v.word().upper()}_PASSWORD"]', f"const {v.camel()} = process.env.{v.word().upper()}_TOKEN{v.pick([';', ' ?? ' + chr(39) * 2 + ';'])}", f'{v.name(PASS_WORDS)} {v.pick(["=", ":="])} {v.pick(["getenv", "System.getenv", "os.Getenv", "vault.get", "config.get", "env::var", "getpass.getpass", "input"])}("{v.word().upper()}_SECRET")',
        f"{v.name(PASS_WORDS)} = {v.word()}.{v.name(['password', 'token'])}", f"{v.name(KEY_WORDS)}: {v.camel()}.{v.camel()},", f"{v.name(PASS_WORDS)}={v.camel()}({v.word()})", f'{v.name(PASS_WORDS)} = data.get("{v.word()}_password")', f"    password=self.{v.word()}_password,",
    ]),
    "said": _said,
    "code": _code,
    "code again": _code,
    "statements": _statement,
    "statements again": _statement,
    "typed": _typed,
    "typed again": _typed,
    "minified": _minified,
    "addresses": _address,
    "public blocks": _public_pem,
    "public keys": lambda v: v.assign(v.name(["public key", "ssh key pub", "cert"]), f"ssh-rsa {v.some(80, ALNUM + '+/')}"),
    "alternatives": lambda v: v.assign(v.name(["pattern", "regex", "words"]), "|".join(v.word() for _ in range(12))),
}


#: Families of many forms are drawn more often.
WEIGHT = {"assigned password": 4, "assigned key": 4, "encoded account": 2, "basic header": 2, "bearer header": 2, "sentence": 2, "address with password": 2, "key block": 2, "markup": 2}


def training_texts(n: int, seed: int, without: tuple[str, ...] = ()) -> list[str]:
    """n invented texts, half of them with a credential; the families `without` are left out."""
    v = Invent(random.Random(seed))
    positive, negative = ([f for name, f in x.items() if name not in without for _ in range(WEIGHT.get(name, 1))] for x in (POSITIVE, NEGATIVE))
    return [v.pick(positive if v.rng.random() < 0.5 else negative)(v) for _ in range(n)]


def held_out_texts(n: int, seed: int, families: tuple[str, ...]) -> list[str]:
    """n invented texts of these families."""
    v = Invent(random.Random(seed))
    each = {**POSITIVE, **NEGATIVE}
    return [each[v.pick(families)](v) for _ in range(n)]
