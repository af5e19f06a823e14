"""Small programs, each with the findings that it has: (ending, text, [(rule, where its sink begins)]). Tests hold the scanner against them, and a query writes them behind every page."""

from __future__ import annotations

_REMARK = "// " + "a long remark " * 30

CASES: dict[str, tuple[str, str, list[tuple[str, str]]]] = {
    'redirect': ('js', 'export function f(req, res) {\n  res.redirect(req.query.to);\n}', [('SE1005', 'res.redirect(')]),
    'not exported': ('js', 'function f(req, res) {\n  res.redirect(req.query.to);\n}', []),
    'overwritten': ('js', "export function f(req) {\n  let u = req.body.url;\n  u = 'https://fixed';\n  fetch(u);\n}", []),
    'comments and strings': ('js', "export function f(req) {\n  // exec(req.query.x)\n  const s = 'exec(req.query.x)';\n}", []),
    'destructured': ('js', 'export const f = async (req) => {\n  const { id } = req.body;\n  await eval(id);\n}', [('SE1006', 'eval(')]),
    'renamed field': ('js', 'export const f = ({ body: given }) => {\n  eval(given.code);\n}', []),
    'mutation': ('js', 'export function f(req, db) {\n  db.user.delete(req.body.id);\n}', [('SE1007', 'db.user.delete(')]),
    'guarded mutation': ('js', 'export function f(req, db) {\n  if (!canAccess(req.user)) { return; }\n  db.user.delete(req.body.id);\n}', []),
    'guard with a remark before it leaves': ('js', 'export function f(req, db) {\n  if (!hasRole(req.user)) {\n    ' + _REMARK + '\n    return;\n  }\n  db.user.delete(req.body.id);\n}', []),
    'guard that logs, then leaves': ('js', "export function f(req, db) {\n  if (!hasRole(req.user)) { log('no'); return; }\n  db.user.delete(req.body.id);\n}", []),
    'guard that only logs': ('js', "export function f(req, db) {\n  if (!hasRole(req.user)) { log('no'); }\n  db.user.delete(req.body.id);\n}", [('SE1007', 'db.user.delete(')]),
    'guard that leaves sometimes': ('js', 'export function f(req, db) {\n  if (!hasRole(req.user)) { if (strict) { return; } }\n  db.user.delete(req.body.id);\n}', [('SE1007', 'db.user.delete(')]),
    'authentication alone': ('js', 'export function f(req, db) {\n  if (!login(req.user)) return;\n  db.user.delete(req.body.id);\n}', [('SE1007', 'db.user.delete(')]),
    'tenant of another value': ('js', 'export function f(req, db) {\n  checkTenantMember(req.query.a);\n  db.user.delete(req.body.id);\n}', [('SE1007', 'db.user.delete(')]),
    'tenant of the value': ('js', 'export function f(req, db) {\n  checkTenantMember(req.body.id);\n  db.user.delete(req.body.id);\n}', []),
    'handler without values': ('js', "app.post('/x', wipe);\nfunction wipe(_req, res) {\n  recordStore.remove('all');\n}", [('SE1007', 'recordStore.remove(')]),
    'other receiver': ('js', 'export function f(req, cache) {\n  cache.rename(req.query.x);\n}', []),
    'receiver': ('js', "export function f(req) {\n  fs.rename(req.query.x, 'y');\n}", [('SE1003', 'fs.rename(')]),
    'class method': ('js', "export default class A {\n  run(req) { return 1; }\n}\nclass B {\n  async go(req) {\n    exec(req.query.x);\n  }\n}\napp.get('/x', b.go);", [('SE1001', 'exec(')]),
    'bare arrow': ('js', "app.get('/x', req => {\n  exec(req.query.x);\n});", [('SE1001', 'exec(')]),
    'arrow without braces': ('js', "app.get('/x', (req, res) => exec(req.query.x));", [('SE1001', 'exec(')]),
    'module level': ('js', 'const key = process.env.API_SECRET;\nconsole.log(key);', [('SE1010', 'console.log(')]),
    'public key': ('js', 'console.log(process.env.PUBLIC_KEY);', []),
    'credential': ('js', 'console.log(process.env.DB_CREDENTIAL);', [('SE1010', 'console.log(')]),
    'option': ('js', "export function f(req) {\n  spawn('git', ['log', req.query.x]);\n}", [('SE1008', 'spawn(')]),
    'option ended': ('js', "export function f(req) {\n  spawn('git', ['log', '--', req.query.x]);\n}", []),
    'shell text': ('js', "export function f(req) {\n  spawn('sh', ['-ec', req.query.x]);\n}", [('SE1001', 'spawn(')]),
    'shell argument': ('js', "export function f(req) {\n  spawn('sh', ['-c', 'echo $1', req.query.x]);\n}", []),
    'shell asked for': ('js', "export function f(req) {\n  spawn(req.query.x, ['a'], { shell: true });\n}", [('SE1001', 'spawn(')]),
    'prototype': ('js', 'export function f(req) {\n  Object.assign(Object.prototype, req.body);\n}', [('SE1009', 'Object.assign(')]),
    'prototype by assignment': ('js', 'export function f(req) {\n  target.__proto__ = req.body;\n}', [('SE1009', 'targ')]),
    'own object': ('js', 'export function f(req) {\n  Object.assign({}, req.body);\n}', []),
    'model before mutation': ('js', 'export function f(req) {\n  userModel.create(req.body);\n}', [('SE1010', 'userModel.create(')]),
    'allowlist': ('js', "const OK = new Set(['a', 'b']);\nexport function f(req) {\n  const x = req.query.x;\n  if (!OK.has(x)) throw new Error('no');\n  exec(x);\n}", []),
    'list of what is denied': ('js', "const DENIED = new Set(['a', 'b']);\nexport function f(req) {\n  const x = req.query.x;\n  if (!DENIED.has(x)) throw new Error('no');\n  exec(x);\n}", [('SE1001', 'exec(')]),
    'another value': ('js', "const OK = new Set(['a', 'b']);\nexport function f(req) {\n  if (!OK.has(req.query.y)) return;\n  exec(req.query.x);\n}", [('SE1001', 'exec(')]),
    'origin': ('js', "export function f(req, res) {\n  const u = new URL(req.query.to);\n  if (u.origin !== 'https://a.invalid') return;\n  res.redirect(u.href);\n}", []),
    'host without protocol': ('js', "export function f(req) {\n  const u = new URL(req.query.to);\n  if (u.hostname !== 'a.invalid') return;\n  fetch(u);\n}", [('SE1004', 'fetch(')]),
    'choice with a fixed rest': ('js', "const OK = ['/a', '/b'];\nexport function f(req, res) {\n  const x = req.query.to;\n  res.redirect(OK.includes(x) ? x : '/a');\n}", []),
    'below its root': ('js', "export function f(req) {\n  const p = path.join(ROOT, req.query.x);\n  if (!p.startsWith(ROOT + path.sep)) throw new Error('no');\n  fs.readFile(p);\n}", []),
    'prefix without separator': ('js', "export function f(req) {\n  const p = path.join(ROOT, req.query.x);\n  if (!p.startsWith(ROOT)) throw new Error('no');\n  fs.readFile(p);\n}", [('SE1003', 'fs.readFile(')]),
    'literal query': ('js', "export function f(req, db) {\n  db.query('select ?', [req.body.a]);\n}", []),
    'subscripts': ('js', "export function f(req) {\n  exec(req.headers['x-name']);\n}", [('SE1001', 'exec(')]),
    'computed index': ('js', "export function f(req) {\n  const table = { a: 'x' };\n  exec(table[req.query.k] ?? 'x');\n}", []),
    'keys are no values': ('js', "export function f(req) {\n  const name = req.query.x;\n  exec({ name: 'fixed' });\n}", []),
    'unwaited check': ('js', 'export async function f(req) {\n  policy.authorizeAsync(req.body.id);\n  store.update(req.body.id);\n}', [('SE1007', 'store.update(')]),
    'waited check': ('js', 'export async function f(req) {\n  await policy.authorizeAsync(req.body.id);\n  store.update(req.body.id);\n}', []),
    'letters beyond ASCII': ('js', 'export function é(req) {\n  exec(req.query.x);\n}', [('SE1001', 'exec(')]),
    'before the sink': ('js', 'export function f(req) {\n  const é = 1;\n  exec(req.query.x);\n}', [('SE1001', 'exec(')]),
    'pattern with a quote': ('js', 'export function f(req) {\n  const ok = /[\'"`{(]/.test(\'x\');\n  exec(req.query.x);\n}', [('SE1001', 'exec(')]),
    'broken': ('js', 'broken ( { export function f(req) { exec(req.query.x', [('SE1001', 'exec(')]),
    'empty': ('js', '', []),
    'py source': ('py', "def f(request):\n    os.system(request.args.get('x'))\n", [('SE1001', 'os.system(')]),
    'py decorated guard': ('py', "@login_required\ndef f(request):\n    x = safe_join('/a', request.args.get('x'))\n    open(x)\n", []),
    'py handler parameter': ('py', "@app.get('/x')\ndef f(name: str):\n    eval(name)\n", [('SE1006', 'eval(')]),
    'py plain parameter': ('py', 'def f(name):\n    eval(name)\n', []),
    'py module level': ('py', "value = request.args.get('x')\nos.system(value)\n", [('SE1001', 'os.system(')]),
    'py parameterized': ('py', "def f(request):\n    cursor.execute('select ?', request.args.get('x'))\n", []),
    'py cleaned': ('py', "def f(request):\n    x = validate_command(request.args.get('x'))\n    os.system(x)\n", []),
    'go receiver': ('go', 'func F(c *gin.Context) {\n\tp := c.Query("p")\n\trunner.Exec(p)\n}\n', []),
    'go command': ('go', 'func F(c *gin.Context) {\n\tp := c.Query("p")\n\texec.Command("sh", "-c", p)\n}\n', [('SE1001', 'exec.Command(')]),
    'go literal query': ('go', 'func F(c *gin.Context) {\n\tdb.Query("select $1", c.Query("p"))\n}\n', []),
    'go control': ('go', 'func F(v string) {\n\tos.ReadFile(v)\n}\n', []),
    'rust chain': ('rs', 'fn routes() { Router::new().route("/x", get(run)) }\nasync fn run(input: String) {\n    Command::new("sh").arg("-c").arg(input).output();\n}\n', [('SE1001', 'arg(i')]),
    'rust files': ('rs', 'fn routes() { Router::new().route("/x", get(run)) }\nasync fn run(input: String) {\n    std::fs::read(input);\n}\n', [('SE1003', 'std::fs::read(')]),
    'rust allowlist': ('rs', 'fn routes() { Router::new().route("/x", get(run)) }\nasync fn run(input: String) {\n    let safe = allowlist(input);\n    std::fs::read(safe);\n}\n', []),
    'raw query': ('js', 'export function f(req, db) {\n  const part = req.body.filter;\n  db.raw(`select * from t where ${part}`);\n}', [('SE1002', 'db.raw(')]),
    'query in parts': ('js', "export function f(req, db) {\n  db.query('select ' + req.query.c);\n}", [('SE1002', 'db.query(')]),
    'request by name': ('js', 'export function f(req) {\n  axios.get(req.query.u);\n}', [('SE1004', 'axios.get(')]),
    'approved host': ('js', "const HOSTS = new Set(['a.invalid']);\nexport function f(req) {\n  const u = new URL(req.query.u);\n  if (u.protocol !== 'https:' || !HOSTS.has(u.hostname)) throw new Error('no');\n  return fetch(u);\n}", []),
    'denied host': ('js', "const BLOCKED = new Set(['a.invalid']);\nexport function f(req) {\n  const u = new URL(req.query.u);\n  if (u.protocol !== 'https:' || !BLOCKED.has(u.hostname)) throw new Error('no');\n  return fetch(u);\n}", [('SE1004', 'fetch(')]),
    'archive entry': ('js', 'export async function f(archive, root) {\n  for (const entry of archive.entries()) {\n    await fs.writeFile(path.join(root, entry.path), entry.bytes);\n  }\n}', [('SE1003', 'fs.writeFile(')]),
    'form of a server action': ('js', "'use server';\nexport async function f(form) {\n  const v = String(form.get('v') ?? '');\n  return exec('show ' + v);\n}", [('SE1001', 'exec(')]),
    'server action': ('js', "'use server';\nexport async function f(change) {\n  await accountStore.update(change);\n}", [('SE1007', 'accountStore.update(')]),
    'py query': ('py', "def f(request):\n    cursor.execute('select ' + request.args.get('c'))\n", [('SE1002', 'cursor.execute(')]),
    'py network': ('py', "def f(request):\n    requests.get(request.args.get('u'))\n", [('SE1004', 'requests.get(')]),
    'py redirect': ('py', "def f(request):\n    return RedirectResponse(request.args.get('u'))\n", [('SE1005', 'RedirectResponse(')]),
    'py files': ('py', "def f(request):\n    open(request.form.get('p'))\n", [('SE1003', 'open(')]),
    'go query': ('go', 'func F(c *gin.Context) {\n\tp := c.Query("p")\n\tdb.Query(p)\n}\n', [('SE1002', 'db.Query(')]),
    'go network': ('go', 'func F(c *gin.Context) {\n\thttp.Get(c.Query("p"))\n}\n', [('SE1004', 'http.Get(')]),
    'go redirect': ('go', 'func F(c *gin.Context) {\n\thttp.Redirect(w, r, c.Query("p"), 302)\n}\n', [('SE1005', 'http.Redirect(')]),
    'rust query': ('rs', 'fn routes() { Router::new().route("/x", get(run)) }\nasync fn run(input: String) {\n    sqlx::query(input);\n}\n', [('SE1002', 'sqlx::query(')]),
    'rust network': ('rs', 'fn routes() { Router::new().route("/x", get(run)) }\nasync fn run(input: String) {\n    reqwest::get(input);\n}\n', [('SE1004', 'reqwest::get(')]),
    'rust redirect': ('rs', 'fn routes() { Router::new().route("/x", get(run)) }\nasync fn run(input: String) {\n    axum::response::Redirect::to(input);\n}\n', [('SE1005', 'axum::response::Redirect::to(')]),
    'check that a catch hides': ('js', 'export function f(req, db) {\n  try {\n    requireRole(req.user);\n  } catch (e) {\n    log(e);\n  }\n  db.user.delete(req.body.id);\n}', [('SE1007', 'db.user.delete(')]),
    'check that a catch passes on': ('js', 'export function f(req, db) {\n  try {\n    requireRole(req.user);\n  } catch (e) {\n    throw e;\n  }\n  db.user.delete(req.body.id);\n}', []),
    'check within the try': ('js', 'export function f(req, db) {\n  try {\n    requireRole(req.user);\n    db.user.delete(req.body.id);\n  } catch (e) {\n    log(e);\n  }\n}', []),
    'check in a branch': ('js', 'export function f(req, db) {\n  if (req.query.fast) {\n    requireRole(req.user);\n  }\n  db.user.delete(req.body.id);\n}', [('SE1007', 'db.user.delete(')]),
    'eval of its own': ('js', 'export function f(req) {\n  const eval = (x) => x;\n  eval(req.query.x);\n}', []),
    'function of text': ('js', 'export function f(req) {\n  new Function("a", req.query.x);\n}', [('SE1006', 'Function(')]),
}
