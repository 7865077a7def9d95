"""The rule catalog as data: 118 rules, their predicates over one syntax-node row, and 60 renames.

A predicate is SQL over the columns of astrel.sources.astnodes; rules without one
are evaluated by a join, a window or an aggregate in astrel.plans.engine.
"""

from __future__ import annotations

from dataclasses import dataclass

PRELUDE = 'import { Effect, Stream, Schema, Layer, Context, Queue, PubSub, Chunk, Config, Schedule, Fiber, Option, Cause, Scope, Duration, HttpServerResponse } from "effect"\n'
LOOPS = ("For", "ForOf", "ForIn", "While", "DoWhile")


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    category: str
    gate: str  # on, v4, adopt, agent or config
    kinds: tuple[str, ...]
    when: str | None
    message: str
    help: str
    bad: str
    good: str
    pos: str = "pos"
    many: str | None = None  # SQL for an array of positions, a finding each

    @property
    def escalates(self) -> bool:
        """Whether a strict run makes its findings errors."""
        kept = ("agent-duplicate-function", "agent-duplicate-cross-file", "agent-near-duplicate-function", "agent-similar-function-name", "agent-similar-shape", "no-ts-ignore", "prefer-strict-tsconfig")
        return self.category in ("agent-hygiene", "oop-to-effect", "type-safety", "maintainability") and self.id not in kept


CATEGORY_LABELS = {
    "correctness": "Correctness", "idiomatic": "Idiomatic", "architecture": "Architecture", "performance": "Performance", "v4-migration": "v4 migration", "adoption": "Adoption",
    "agent-hygiene": "Agent hygiene", "oop-to-effect": "OOP to Effect", "type-safety": "Type safety", "maintainability": "Maintainability", "design-system": "Design system", "type-aware": "Type-aware", "react": "React",
}


def _in(*names: str) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _call(module: str, *props: str) -> str:
    return f"module = '{module}' and prop in {_in(*props)}"


_FN = "get(filter(args, a -> a.kind in ('Arrow', 'Function')), 0)"
_A0 = "get(args, 0)"
_NO_CONC = "not exists(args, a -> coalesce(array_contains(a.keys, 'concurrency'), false))"
_EXPR = "filter(args, a -> a.kind <> 'Spread')"
_LOG = _in("log", "logDebug", "logInfo", "logWarning", "logError", "logTrace", "logFatal")
_RUN = ("runPromise", "runSync", "runFork", "runPromiseExit", "runSyncExit", "runCallback")
_SCHEMA_CLASS = _in("Class", "TaggedClass", "TaggedError", "TaggedErrorClass", "TaggedRequest")
_FACTORY = f"(c.module = 'Schema' and c.prop in {_SCHEMA_CLASS} or c.module = 'Context' and c.prop in ('Tag', 'Service', 'GenericTag', 'Reference') or c.module = 'Effect' and c.prop in ('Tag', 'Service'))"
_SELF = "get(filter(chain, c -> c.type_arg is not null), 0)"
_DURATION = (
    "(module = 'Effect' and prop in ('sleep', 'delay', 'timeout', 'timeoutTo', 'timeoutFail', 'interruptAfter', 'cachedWithTTL') or module = 'Schedule' and prop in ('spaced', 'fixed', 'exponential', 'upTo') "
    "or module = 'Stream' and prop in ('timeout', 'debounce', 'interruptAfter', 'groupedWithin'))"
)
_FIRST_NUM = f"get(filter(slice({_EXPR}, 1, 2), a -> a.num is not null), 0)"
_TAGS = "map('Some', 'Option.isSome', 'None', 'Option.isNone', 'Left', 'Either.isLeft', 'Right', 'Either.isRight', 'Success', 'Exit.isSuccess', 'Failure', 'Exit.isFailure')"
_EQ = "operator in ('==', '!=', '===', '!==')"
_LITERAL = "('Object', 'Array')"
_TAG_STR = "if(left_tag, right_str, if(right_tag, left_str, null))"
_NODE = "map('fs', 'FileSystem', 'fs/promises', 'FileSystem', 'path', 'Path', 'child_process', 'Command', 'http', 'HttpServer', 'https', 'HttpServer')"
_FIELDS = "transform(filter(members, m -> m.kind = 'Property'), m -> m.name)"
_METHODS = "transform(filter(members, m -> m.kind = 'Method'), m -> m.name)"
_LAST = f"element_at({_EXPR}, -1)"
_HANDLER = f"coalesce({_FN}.below, try_below)"
_PROMISES = "array('O:Promise.all', 'O:Promise.allSettled', 'O:Promise.race', 'O:Promise.any')"


def _r(*a, **k) -> Rule:
    return Rule(*a, **k)


_C, _I, _A, _P, _V, _D, _H, _O, _T, _M = "correctness", "idiomatic", "architecture", "performance", "v4-migration", "adoption", "agent-hygiene", "oop-to-effect", "type-safety", "maintainability"
_GEN = "const p = Effect.gen(function* () { %s })"
_CB = "const p = Effect.sync(() => { %s })"

RULES: tuple[Rule, ...] = (
    _r("require-yield-star", "error", _C, "on", ("Yield",), "not flag and in_gen", "'plain yield in an effect generator'", "An effect is only run by yield*.", _GEN % "yield Effect.void", _GEN % "yield* Effect.void"),
    _r("no-try-catch-in-gen", "error", _C, "on", ("Try",), "flag and in_gen", "'try/catch in an effect generator'", "Failures of effects are not thrown: recover with catchTag or catchAll.", _GEN % "try { yield* Effect.void } catch (e) { foo(e) }", _GEN % "yield* Effect.void"),
    _r("no-try-finally-in-gen", "warn", _C, "on", ("Try",), "not flag and left_kind = 'Finally' and own_yield and in_gen", "'try/finally around a yield'", "Finalisers belong in Effect.ensuring or acquireRelease.", _GEN % "try { yield* Effect.void } finally { foo() }", _GEN % "try { foo() } finally { bar() }"),
    _r("no-throw-in-effect", "error", _C, "on", ("Throw",), "in_gen", "'throw in an effect generator'", "A thrown value becomes a defect; fail with a typed error.", _GEN % "throw new Error('x')", _GEN % "const f = () => { throw new Error('x') }"),
    _r("no-run-inside-effect", "error", _C, "on", ("Call",), f"{_call('Effect', *_RUN)} and in_code", "concat('Effect.', prop, ' inside effect code')", "Running an effect inside another loses its fiber: yield it.", _GEN % "Effect.runSync(x)", "Effect.runSync(x)"),
    _r("schema-class-self-mismatch", "error", _C, "on", ("Class",), f"exists(chain, c -> {_FACTORY}) and name is not null and {_SELF}.type_arg <> name", f"concat('class ', name, ' names itself ', {_SELF}.type_arg)", "The Self argument must be the class itself.", 'class A extends Schema.Class<B>("A")({}) {}', 'class A extends Schema.Class<A>("A")({}) {}', pos=f"{_SELF}.type_pos"),
    _r("no-constructor-override-in-schema-class", "error", _C, "on", ("Class",), f"name is not null and get(filter(chain, c -> c.module = 'Schema'), 0).prop in {_SCHEMA_CLASS}", "concat('constructor in schema class ', name)", "Decoding bypasses an overridden constructor.", 'class A extends Schema.Class<A>("A")({}) { constructor() { super({}) } }', 'class A extends Schema.Class<A>("A")({}) { size() { return 1 } }', many="transform(filter(members, m -> m.kind = 'constructor'), m -> m.pos)"),
    _r("no-async-callback-in-effect-combinators", "error", _C, "on", ("Call",), f"module in ('Effect', 'Stream') and prop in {_in('map', 'flatMap', 'andThen', 'tap', 'sync', 'try', 'filter', 'forEach', 'reduce', 'mapEffect')} and exists(args, a -> a.is_async)", "concat('async function given to ', module, '.', prop)", "Its promise would become the value: use tryPromise.", "Effect.map(x, async (a) => a)", "Effect.map(x, (a) => a)", pos="get(filter(args, a -> a.is_async), 0).pos"),
    _r("no-then-in-sync", "warn", _C, "on", ("Call",), f"{_call('Effect', 'sync')} and arrays_overlap({_FN}.below, array('P:then', 'P:catch', 'P:finally', 'N:Promise'))", "'promise inside Effect.sync'", "Effect.sync doesn't wait for promises.", "Effect.sync(() => fetchIt().then(f))", "Effect.sync(() => fetchIt())"),
    _r("no-promise-all-in-effect", "warn", _C, "on", ("Call",), f"{_call('Effect', 'promise', 'tryPromise')} and arrays_overlap({_HANDLER}, {_PROMISES})", f"concat(substring(get(filter({_HANDLER}, b -> array_contains({_PROMISES}, b)), 0), 3), ' inside Effect.', prop)", "Effect.all keeps interruption and typed errors.", "Effect.tryPromise(() => Promise.all([a, b]))", "Effect.tryPromise(() => a())"),
    _r("require-typed-catch-in-try", "info", _I, "on", ("Call",), f"{_call('Effect', 'tryPromise')} and {_FN} is not null", "'Effect.tryPromise without a catch'", "Map the rejection to a typed error.", "Effect.tryPromise(() => a())", "Effect.tryPromise({ try: () => a(), catch: (e) => new E() })"),
    _r("no-runsync-on-async-effect", "error", _C, "on", ("Call",), f"{_call('Effect', 'runSync', 'runSyncExit')} and arrays_overlap({_A0}.below, array('M:Effect.promise', 'M:Effect.tryPromise', 'M:Effect.async', 'M:Effect.sleep', 'M:Effect.delay', 'M:Effect.never'))", "concat('Effect.', prop, ' on an asynchronous effect')", "It fails at run time: use runPromise.", "Effect.runSync(Effect.sleep('1 second'))", "Effect.runSync(Effect.succeed(1))"),
    _r("no-map-returning-effect", "warn", _C, "on", ("Call",), f"module in ('Effect', 'Stream') and prop = 'map' and {_FN}.res_kind = 'Call' and {_FN}.res_module in ('Effect', 'Stream') and not startswith({_FN}.res_prop, 'is')", "concat(module, '.map returns an effect')", "The inner effect never runs: use flatMap.", "Effect.map(x, (a) => Effect.succeed(a))", "Effect.map(x, (a) => a + 1)"),
    _r("no-runcollect-on-infinite-stream", "error", _C, "on", ("Call",), "member_prop = 'pipe' and recv_module = 'Stream' and (recv_prop in ('tick', 'forever', 'repeatValue', 'repeatEffect', 'repeatEffectOption', 'fromSchedule', 'iterate') or recv_prop = 'range' and get(recv_names, 1) = 'Infinity') and exists(args, a -> a.module = 'Stream' and a.prop = 'runCollect') and not exists(args, a -> coalesce(a.module = 'Stream' and a.prop in ('take', 'takeUntil', 'takeUntilEffect', 'takeWhile', 'timeout', 'timeoutTo', 'interruptAfter', 'interruptWhen', 'runDrain'), false))", "concat('runCollect on endless Stream.', recv_prop)", "Bound the stream before collecting it.", "Stream.iterate(1, f).pipe(Stream.runCollect)", "Stream.iterate(1, f).pipe(Stream.take(3), Stream.runCollect)"),
    _r("no-eager-chunk-stream", "info", _P, "on", ("Call",), f"{_call('Stream', 'fromChunk')} and {_A0}.kind = 'Call' and {_A0}.module = 'Chunk' and {_A0}.prop = 'fromIterable'", "'chunk built before streaming'", "Stream.fromIterable is lazy.", "Stream.fromChunk(Chunk.fromIterable(xs))", "Stream.fromIterable(xs)"),
    _r("stream-mapeffect-missing-concurrency", "info", _P, "on", ("Call",), f"{_call('Stream', 'mapEffect')} and {_NO_CONC}", "'Stream.mapEffect without concurrency'", "It handles one element at a time unless told otherwise.", "Stream.mapEffect(s, f)", "Stream.mapEffect(s, f, { concurrency: 4 })"),
    _r("prefer-queue-bounded", "info", _P, "on", ("Call",), "module in ('Queue', 'PubSub') and prop = 'unbounded'", "concat(module, '.unbounded')", "Nothing holds a fast producer back.", "Queue.unbounded()", "Queue.bounded(16)"),
    _r("no-object-literal-comparison", "warn", _C, "on", ("Binary", "Call"), f"kind = 'Binary' and {_EQ} and (left_kind in {_LITERAL} or right_kind in {_LITERAL}) or kind = 'Call' and member_prop in ('includes', 'indexOf') and {_A0}.kind in {_LITERAL}", "'comparison with a new object'", "A new object equals nothing: use Equal.equals.", "const a = x === {}", "const a = x === y"),
    _r("no-tag-string-comparison", "warn", _I, "on", ("Binary",), f"{_EQ} and not (left_kind in {_LITERAL} or right_kind in {_LITERAL}) and {_TAGS}[{_TAG_STR}] is not null", f"concat('compare with ', {_TAGS}[{_TAG_STR}])", "Built-in types have predicates.", 'const a = x._tag === "Some"', 'const a = x._tag === "Mine"'),
    _r("prefer-match-over-tag-switch", "info", _I, "on", ("Switch",), "left_tag", "'switch over _tag'", "Match checks that all cases are there.", "switch (x._tag) { case 'A': f() }", "switch (x.kind) { case 'A': f() }"),
    _r("no-string-errors", "warn", _I, "on", ("Call",), f"{_call('Effect', 'fail')} and {_A0}.kind in ('String', 'Template') or {_call('Effect', 'try', 'tryPromise')} and catch_res in ('String', 'Template')", "'error is a string'", "Errors need a tag to be caught by.", "Effect.fail('bad')", "Effect.fail(new Bad())"),
    _r("no-catchall-to-null", "warn", _C, "on", ("Call",), f"{_call('Effect', 'catchAll', 'catch')} and ({_FN}.res_kind = 'Call' and {_FN}.res_module = 'Effect' and {_FN}.res_prop = 'succeed' and {_FN}.res_arg0 = 'Nullish' or {_FN}.res_kind = 'Member' and {_FN}.res_module = 'Effect' and {_FN}.res_prop = 'void')", "concat('Effect.', prop, ' hides every failure')", "Catch what is expected only.", "Effect.catchAll(x, () => Effect.succeed(null))", "Effect.catchAll(x, (e) => Effect.succeed(e))"),
    _r("no-orDie-to-silence-errors", "info", _C, "on", ("Member",), "module in ('Effect', 'Layer') and prop = 'orDie'", "concat(module, '.orDie')", "It turns failures into defects.", "const p = x.pipe(Effect.orDie)", "const p = x.pipe(Effect.option)"),
    _r("prefer-config-redacted", "warn", _C, "on", ("Call",), f"{_call('Config', 'string')} and regexp_replace(lower({_A0}.str), '[^a-z0-9]', '') rlike 'secret|password|passwd|token|apikey|privatekey|credential'", f"concat('secret ', {_A0}.str, ' read as text')", "Config.redacted keeps it out of logs.", 'Config.string("API_KEY")', 'Config.string("PORT")'),
    _r("prefer-foreach-over-yield-loop", "info", _I, "on", LOOPS, "in_gen and own_yield", "'loop that yields'", "Effect.forEach says so and can run in parallel.", _GEN % "for (const a of xs) { yield* f(a) }", _GEN % "for (const a of xs) { f(a) }"),
    _r("prefer-timeout-over-race-sleep", "warn", _I, "on", ("Call",), f"{_call('Effect', 'race', 'raceAll', 'raceFirst')} and exists(args, a -> a.sleeps)", "'race against a sleep'", "Effect.timeout does that.", "Effect.race(x, Effect.sleep('1 second'))", "Effect.race(x, y)"),
    _r("no-fork-then-immediate-join", "warn", _I, "on", (), None, "'fork joined at once'", "Yield the effect itself.", _GEN % "const f = yield* Effect.fork(x); yield* Fiber.join(f)", _GEN % "const f = yield* Effect.fork(x); yield* y; yield* Fiber.join(f)"),
    _r("no-nested-gen-yield", "info", _I, "on", ("Yield",), "flag and in_gen and generator", "'generator yielded in a generator'", "Write its statements here.", _GEN % "yield* Effect.gen(function* () { yield* a })", _GEN % "yield* a"),
    _r("no-effect-fn-iife", "warn", _I, "on", ("Call",), "inner_module = 'Effect' and inner_prop in ('fn', 'fnUntraced') and inner_generator", "concat('Effect.', inner_prop, ' called at once')", "Effect.gen needs no call.", "Effect.fn(function* () { yield* a })()", 'Effect.fn("load")(function* () { yield* a })'),
    _r("no-unnecessary-pipe-chain", "info", _I, "on", ("Call",), f"member_prop = 'pipe' and recv_member = 'pipe' or callee_name = 'pipe' and {_A0}.callee = 'pipe'", "'pipe of a pipe'", "One pipe takes all steps.", "x.pipe(a).pipe(b)", "x.pipe(a, b)"),
    _r("no-return-effect-in-gen", "info", _I, "on", ("Return",), "in_gen and module = 'Effect' and not startswith(prop, 'is') and not startswith(prop, 'run')", "concat('returns Effect.', prop)", "Did you mean return yield*?", _GEN % "return Effect.succeed(1)", _GEN % "return Effect.isEffect(x)"),
    _r("redundant-schema-tag-identifier", "info", _I, "on", ("Class",), "get(chain, 1).module = 'Schema' and get(chain, 1).prop in ('TaggedClass', 'TaggedError', 'TaggedErrorClass', 'TaggedRequest') and get(chain, 1).str = get(chain, 0).str", "concat('identifier repeats the tag ', get(chain, 0).str)", "The tag is the default.", 'class A extends Schema.TaggedClass<A>("A")("A", {}) {}', 'class A extends Schema.TaggedClass<A>()("A", {}) {}', pos="get(chain, 1).str_pos"),
    _r("no-unnecessary-gen", "info", _I, "on", ("Call",), f"{_call('Effect', 'gen')} and only_gen", "'generator of one return'", "Use the effect itself.", _GEN % "return yield* a", _GEN % "const b = yield* a; return b"),
    _r("no-unnecessary-fail-of-yieldable", "info", _I, "on", ("Yield",), f"flag and in_gen and module = 'Effect' and prop = 'fail' and {_A0}.kind = 'New'", "'Effect.fail of a yieldable error'", "Tagged errors can be yielded.", _GEN % "yield* Effect.fail(new E())", _GEN % "yield* new E()"),
    _r("no-effect-do-notation", "info", _I, "on", ("Member",), "module = 'Effect' and prop = 'Do'", "'Effect.Do'", "Generators read better.", "const p = Effect.Do.pipe(a)", _GEN % "yield* a"),
    _r("prefer-effect-void", "info", _I, "on", ("Call",), f"{_call('Effect', 'succeed')} and {_A0}.kind = 'Undefined'", "'Effect.succeed(undefined)'", "Effect.void is the same.", "Effect.succeed(undefined)", "Effect.succeed(1)"),
    _r("prefer-as-void", "info", _I, "on", ("Call",), f"{_call('Effect', 'map')} and size({_EXPR}) > 0 and {_LAST}.kind = 'Arrow' and {_LAST}.n_params = 0 and {_LAST}.concise and {_LAST}.res_kind in ('Undefined', 'String', 'Number', 'Boolean', 'Null')", "'map to a constant'", "Effect.as and Effect.asVoid say that.", "Effect.map(x, () => undefined)", "Effect.map(x, () => f())"),
    _r("prefer-flatmap-over-map-flatten", "info", _I, "on", ("Call",), f"{_call('Effect', 'flatten')} and {_A0}.kind = 'Call' and {_A0}.module = 'Effect' and {_A0}.prop = 'map' or member_prop = 'pipe' and size(args) > 1", "'map and flatten'", "Effect.flatMap is both.", "x.pipe(Effect.map(f), Effect.flatten)", "x.pipe(Effect.flatMap(f))", many="if(coalesce(module = 'Effect' and prop = 'flatten', false), array(pos), transform(filter(if(size(args) > 1, sequence(0, size(args) - 2), cast(array() as array<int>)), i -> args[i].kind = 'Call' and args[i].module = 'Effect' and args[i].prop = 'map' and args[i + 1].kind = 'Member' and args[i + 1].module = 'Effect' and args[i + 1].prop = 'flatten'), i -> pos))"),
    _r("no-unnecessary-pipe", "info", _I, "on", ("Call",), "member_prop = 'pipe' and size(args) = 0", "'pipe without steps'", "It does nothing.", "x.pipe()", "x.pipe(a)"),
    _r("prefer-catch-tag", "warn", _I, "on", ("Call",), f"{_call('Effect', 'catch', 'catchAll')} and {_FN}.on_tag", "concat('Effect.', prop, ' branches on _tag')", "catchTag narrows the error.", 'Effect.catchAll(x, (e) => e._tag === "A" ? a : b)', "Effect.catchAll(x, (e) => f(e))"),
    _r("catch-to-map-error", "info", _I, "on", ("Call",), f"{_call('Effect', 'catch', 'catchAll')} and not {_FN}.on_tag and {_FN}.kind = 'Arrow' and {_FN}.concise and {_FN}.res_kind = 'Call' and {_FN}.res_module = 'Effect' and {_FN}.res_prop = 'fail'", "concat('Effect.', prop, ' fails again')", "mapError says that.", "Effect.catchAll(x, (e) => Effect.fail(f(e)))", "Effect.mapError(x, f)"),
    _r("prefer-clock-service", "warn", _I, "on", ("Call", "New"), "in_code and (kind = 'Call' and object_name = 'Date' and member_prop = 'now' or kind = 'New' and callee_name = 'Date' and size(args) = 0)", "'wall clock in effect code'", "Clock can be controlled in tests.", _CB % "Date.now()", "const a = Date.now()"),
    _r("prefer-random-service", "warn", _I, "on", ("Call",), "in_code and object_name = 'Math' and member_prop = 'random'", "'Math.random in effect code'", "Random can be seeded.", _CB % "Math.random()", "const a = Math.random()"),
    _r("prefer-effect-logging", "warn", _I, "on", ("Call",), "in_code and object_name = 'console' and member_prop in ('log', 'warn', 'error', 'info', 'debug', 'trace')", "concat('console.', member_prop, ' in effect code')", "Effect.log carries spans and levels.", _CB % "console.log(1)", "console.log(1)"),
    _r("prefer-effect-timers", "warn", _I, "on", ("Call",), "in_code and callee_name in ('setTimeout', 'setInterval')", "concat(callee_name, ' in effect code')", "Timers aren't interrupted; sleeps are.", _CB % "setTimeout(f, 1)", "setTimeout(f, 1)"),
    _r("prefer-platform-fetch", "warn", _I, "on", ("Call",), "in_code and callee_name = 'fetch'", "'fetch in effect code'", "HttpClient has typed errors.", _CB % "fetch(u)", "fetch(u)"),
    _r("prefer-config-module", "warn", _I, "on", ("Member",), "in_code and object_name = 'process' and member_prop = 'env'", "'process.env in effect code'", "Config validates and can be replaced.", _CB % "return process.env.A", "const a = process.env.A"),
    _r("prefer-schema-over-json", "info", _I, "on", ("Call",), "in_code and object_name = 'JSON' and member_prop in ('parse', 'stringify')", "concat('JSON.', member_prop, ' in effect code')", "Schema checks what it reads.", _CB % "JSON.parse(a)", "JSON.parse(a)"),
    _r("prefer-effect-fn", "warn", _I, "on", ("Function", "Arrow"), "n_params > 0 and only_gen and not generator", "'function that only returns Effect.gen'", "Effect.fn adds a span.", "const f = (a) => Effect.gen(function* () { yield* a })", "const f = () => Effect.gen(function* () { yield* a })"),
    _r("prefer-tagged-error-classes", "warn", _I, "on", ("Class",), "object_name = 'Error'", "'error class without a tag'", "Data.TaggedError can be caught by tag.", "class A extends Error {}", "class A extends Base {}"),
    _r("prefer-decode-effect", "warn", _I, "on", ("Call",), f"in_code and {_call('Schema', 'decodeUnknownSync', 'decodeSync', 'encodeSync', 'encodeUnknownSync')}", "concat('Schema.', prop, ' in effect code')", "It throws; the effectful form fails.", _CB % "Schema.decodeSync(S)(a)", "const d = Schema.decodeSync(S)"),
    _r("meaningful-span-names", "info", _I, "on", ("Call",), f"{_call('Effect', 'fn', 'fnUntraced', 'withSpan')} and lower(get(filter(args, a -> a.str is not null), 0).str) in {_in('run', 'helper', 'process', 'main', 'handler', 'fn', 'function', 'do', 'execute', 'step', 'task', 'work', 'op')}", "concat('span named ', get(filter(args, a -> a.str is not null), 0).str)", "Name what the span does.", 'Effect.withSpan("run")', 'Effect.withSpan("load user")', pos="get(filter(args, a -> a.str is not null), 0).pos"),
    _r("prefer-node-effect-counterparts", "info", _I, "on", ("Import",), f"{_NODE}[regexp_replace(str, '^node:', '')] is not null", f"concat(str, ' has a service: ', {_NODE}[regexp_replace(str, '^node:', '')])", "Platform services can be replaced in tests.", 'import * as fs from "node:fs"', 'import * as os from "node:os"'),
    _r("prefer-it-effect", "warn", _I, "on", ("Call",), f"callee_name in ('it', 'test') and get({_EXPR}, 1).kind = 'Arrow' and get({_EXPR}, 1).concise and get({_EXPR}, 1).res_kind = 'Call' and get({_EXPR}, 1).res_module = 'Effect' and get({_EXPR}, 1).res_prop in ('runPromise', 'runPromiseExit')", "'test that runs an effect by hand'", "it.effect does that.", "it('a', () => Effect.runPromise(x))", "it('a', () => x)"),
    _r("prefer-abort-signal-passthrough", "info", _I, "on", ("Call",), f"{_call('Effect', 'tryPromise', 'promise')} and coalesce({_FN}.n_params, try_params) = 0 and array_contains({_HANDLER}, 'F:fetch')", "'fetch without the abort signal'", "The handler gets a signal: pass it on.", "Effect.tryPromise(() => fetch(u))", "Effect.tryPromise((signal) => fetch(u, { signal }))"),
    _r("prefer-gen-over-nested-flatmap", "info", _I, "on", ("Call",), f"{_call('Effect', 'flatMap', 'andThen')} and arrays_overlap({_FN}.below, array('M:Effect.flatMap', 'M:Effect.andThen'))", "concat('Effect.', prop, ' nested')", "A generator is flat.", "Effect.flatMap(x, (a) => Effect.flatMap(y, f))", "Effect.flatMap(x, (a) => f(a))"),
    _r("prefer-duration-over-raw-millis", "info", _I, "on", ("Call",), f"{_DURATION} and get({_EXPR}, 0).str is null and {_FIRST_NUM} is not null", f"concat(module, '.', prop, '(', {_FIRST_NUM}.num, ')')", "A bare number has no unit.", "Effect.sleep(500)", 'Effect.sleep("500 millis")', pos=f"{_FIRST_NUM}.pos"),
    _r("prefer-succeed-over-sync-literal", "info", _I, "on", ("Call",), f"{_call('Effect', 'sync')} and {_A0}.kind = 'Arrow' and {_A0}.concise and {_A0}.res_kind in ('String', 'Number', 'Boolean', 'Null', 'PlainTemplate')", "'Effect.sync of a literal'", "Effect.succeed needs no function.", "Effect.sync(() => 1)", "Effect.sync(() => f())"),
    _r("prefer-structured-logging-args", "info", _I, "on", ("Call",), f"module = 'Effect' and prop in {_LOG} and exists(args, a -> array_contains(a.below, 'T:O:JSON.stringify'))", "'JSON inside a log template'", "Log the value as an annotation.", "Effect.log(`a ${JSON.stringify(x)}`)", "Effect.log(`a ${x}`)"),
    _r("prefer-json-response-helper", "warn", _I, "on", ("Call",), f"{_call('HttpServerResponse', 'text')} and {_A0}.name = 'JSON.stringify'", "'JSON sent as text'", "HttpServerResponse.json sets the type.", "HttpServerResponse.text(JSON.stringify(a))", "HttpServerResponse.text(a)"),
    _r("avoid-long-combinator-chains", "info", _I, "on", ("Call",), "member_prop = 'pipe' and size(filter(args, a -> a.kind = 'Call' and a.module = 'Effect' and a.prop in ('flatMap', 'andThen'))) >= 4", "'four or more sequenced steps in a pipe'", "A generator is easier to read.", "x.pipe(Effect.andThen(a), Effect.andThen(b), Effect.flatMap(c), Effect.andThen(d))", "x.pipe(Effect.andThen(a), Effect.andThen(b))"),
    _r("no-layer-mergeall-megalist", "info", _A, "on", ("Call",), f"{_call('Layer', 'mergeAll')} and size(args) > 10", "concat('Layer.mergeAll of ', size(args))", "Group layers by area.", "Layer.mergeAll(a, b, c, d, e, f, g, h, i, j, k)", "Layer.mergeAll(a, b)"),
    _r("no-chained-provides", "warn", _A, "on", ("Call",), "member_prop = 'pipe' and size(filter(args, a -> a.kind = 'Call' and a.module = 'Effect' and a.prop = 'provide')) >= 2", "'several provides in a pipe'", "Merge the layers and provide once.", "x.pipe(Effect.provide(a), Effect.provide(b))", "x.pipe(Effect.provide(a))"),
    _r("no-manual-sql-transactions", "warn", _A, "on", ("TaggedTemplate",), "name = 'sql' and upper(trim(str)) rlike '^(BEGIN|COMMIT|ROLLBACK)'", "'transaction by hand'", "sql.withTransaction rolls back on failure.", "const a = sql`BEGIN`", "const a = sql`SELECT 1`"),
    _r("retry-only-retryable", "info", _A, "on", ("Call",), f"{_call('Effect', 'retry')} and size(args) >= 1 and not exists(args, a -> coalesce(arrays_overlap(a.keys, array('while', 'until')), false))", "'retry of every error'", "Give a condition.", "Effect.retry(x, policy)", "Effect.retry(x, { while: f })"),
    _r("add-jitter-to-backoff", "info", _P, "on", (), None, "'backoff without jitter'", "Clients that back off together collide again.", "const s = Schedule.exponential('1 second')", "const s = Schedule.exponential('1 second').pipe(Schedule.jittered)"),
    _r("cap-exponential-backoff", "info", _P, "on", (), None, "'backoff without a cap'", "Delays double without end.", "const s = Schedule.exponential('1 second')", "const s = Schedule.exponential('1 second').pipe(Schedule.union(t))"),
    _r("no-unbounded-concurrency", "info", _P, "on", ("Call",), "exists(args, a -> size(a.unbounded) > 0)", "'unbounded concurrency'", "Bound it to what the other side takes.", 'f(x, { concurrency: "unbounded" })', "f(x, { concurrency: 4 })", many="flatten(transform(filter(args, a -> size(a.unbounded) > 0), a -> a.unbounded))"),
    _r("effect-all-missing-concurrency", "info", _P, "on", ("Call",), f"({_call('Effect', 'all')} and {_A0}.kind = 'Array' and {_A0}.n_args >= 2 or {_call('Effect', 'forEach')} and size(args) >= 2) and {_NO_CONC}", "concat('Effect.', prop, ' without concurrency')", "It runs in sequence unless told otherwise.", "Effect.all([a, b])", "Effect.all([a, b], { concurrency: 2 })"),
    _r("hoist-schema-codecs", "info", _P, "on", ("Call",), "callee_kind = 'Call' and inner_module = 'Schema' and inner_prop rlike '^(decode|encode)'", "concat('Schema.', inner_prop, ' built for one use')", "Build the codec once.", "Schema.decodeSync(S)(x)", "const d = Schema.decodeSync(S)"),
    _r("v4-no-gen-adapter", "warn", _V, "on", ("Call",), f"{_call('Effect', 'gen')} and n_params >= 1", "'generator adapter'", "yield* needs no adapter.", "Effect.gen(function* (_) { yield* _(a) })", "Effect.gen(function* () { yield* a })", pos="params_pos"),
    _r("v4-fiberref-removed", "error", _V, "v4", ("Import",), f"str = 'effect' and arrays_overlap(imported, array('FiberRef', 'FiberRefs', 'FiberRefsPatch', 'Differ')) or str in {_in('effect/FiberRef', 'effect/FiberRefs', 'effect/FiberRefsPatch', 'effect/Differ')}", "'import of a removed module'", "Use references from Context.", 'import { FiberRef } from "effect"', 'import { Ref } from "effect"'),
    _r("v4-package-consolidation", "error", _V, "v4", ("Import",), f"str in {_in('@effect/platform', '@effect/rpc', '@effect/cluster')}", "concat(str, ' is part of effect')", "Import from the effect package.", 'import { A } from "@effect/platform"', 'import { A } from "@effect/vitest"'),
    _r("v4-unstable-import-awareness", "info", _V, "v4", ("Import",), "startswith(str, 'effect/unstable/')", "concat(str, ' is unstable')", "It may change in a minor release.", 'import { A } from "effect/unstable/http"', 'import { A } from "effect/Schema"'),
    *(_r(f"v4-{i}", "error", _V, "v4", (), None, "'renamed'", h, b, g) for i, h, b, g in (
        ("catch-renames", "The catch family has new names.", "const a = Effect.catchAll", "const a = Effect.catchTag"), ("fork-renames", "The fork family has new names.", "const a = Effect.fork", "const a = Effect.forkScoped"),
        ("context-service", "Services are made by Context.Service.", "const a = Context.GenericTag", "const a = Context.make"), ("runtime-removed", "Runtimes are contexts now.", "const a = Effect.runtime", "const a = Effect.context"),
        ("scope-provide", "Scope.extend is Scope.provide.", "const a = Scope.extend", "const a = Scope.make"), ("layer-scoped-to-effect", "Layer.scoped is Layer.effect.", "const a = Layer.scoped", "const a = Layer.succeed"),
        ("option-renames", "Option.fromNullable has a new name.", "const a = Option.fromNullable", "const a = Option.some"), ("cause-flattened", "Causes are flat lists of reasons.", "const a = Cause.isDie", "const a = Cause.fail"),
    )),
    _r("v4-schema-renames", "error", _V, "v4", ("Call",), f"module = 'Schema' and (prop = 'Literal' and size(args) > 1 or prop in ('Union', 'Tuple') and size(args) >= 2 and {_A0}.kind <> 'Array' or prop = 'Record' and size(args) = 1 and {_A0}.kind = 'Object')", "concat('Schema.', prop, ' takes other arguments')", "Schema has new names and shapes.", "const a = Schema.decodeUnknown", "const a = Schema.String"),
    _r("v4-gen-self-options", "error", _V, "v4", ("Call",), f"{_call('Effect', 'gen')} and {_A0}.kind = 'This'", "'Effect.gen(this, ...)'", "Pass { self: this }.", "Effect.gen(this, function* () {})", "Effect.gen({ self: this }, function* () {})"),
    _r("adopt-async-function", "info", _D, "adopt", ("Function", "Arrow"), "is_async", "'async function'", "An effect can be interrupted and has typed errors.", "async function f() {}", "function f() {}"),
    _r("adopt-promise-chain", "info", _D, "adopt", ("Call",), "member_prop = 'then' and size(args) >= 1 and not (recv_member <=> 'then')", "'promise chain'", "Effect.flatMap sequences lazily.", "p.then(f).then(g)", "p.map(f)"),
    _r("adopt-promise-all", "info", _D, "adopt", ("Call",), "not in_code and object_name = 'Promise' and member_prop in ('all', 'allSettled', 'race', 'any')", "concat('Promise.', member_prop)", "Effect.all bounds concurrency.", "Promise.all([a, b])", "Promise.resolve(a)"),
    _r("adopt-new-promise", "info", _D, "adopt", ("New",), "not in_code and callee_name = 'Promise'", "'new Promise'", "Effect.async has a cleanup.", "new Promise(f)", "new Thing(f)"),
    _r("adopt-await-in-loop", "warn", _D, "adopt", LOOPS, "own_await and not (in_gen and own_yield)", "'await in a loop'", "Effect.forEach can run in parallel.", "async function f() { for (const a of xs) { await g(a) } }", "async function f() { for (const a of xs) { g(a) } }"),
    _r("agent-no-if-else-chain", "warn", _H, "agent", ("If",), "flag and left_kind is null", "'if with else'", "Match or a lookup table covers all cases.", "if (a) { f() } else if (b) { g() } else { h() }", "if (a) { f() }"),
    _r("agent-no-ternary", "warn", _H, "agent", ("Conditional",), "true", "'conditional expression'", "Match says what it decides on.", "const a = b ? c : d", "const a = f(b)"),
    _r("agent-no-string-equality-guard", "warn", _H, "agent", ("Binary",), f"{_EQ} and (left_str is not null and not right_tag or right_str is not null and not left_tag)", "'comparison with a string'", "Parse to a typed value first.", "const a = b === 'x'", "const a = b._tag === 'x'"),
    _r("agent-no-raw-loop", "warn", _H, "agent", LOOPS, "true", "'loop'", "Array and Effect combinators name the intent.", "for (const a of xs) f(a)", "xs.forEach(f)"),
    _r("agent-no-let", "warn", _H, "agent", ("VariableDeclaration",), "name in ('let', 'var')", "concat(name, ' declaration')", "Bind once with const.", "let a = 1", "const a = 1"),
    _r("agent-duplicate-function", "info", _H, "agent", (), None, "'same body elsewhere in this file'", "Share one function.", "const f = (a) => { const b = a.x + 1; if (b > 2) { return g(b) } return h(b, a.y) }\nconst k = (c) => { const d = c.x + 1; if (d > 2) { return g(d) } return h(d, c.y) }", "const f = (a) => { const b = a.x + 1; if (b > 2) { return g(b) } return h(b, a.y) }"),
    _r("agent-no-mutation", "warn", _H, "agent", ("Assignment",), "true", "if(left_kind = 'Identifier', 'reassignment', 'in-place mutation')", "Make a new value.", "a.b = 1", "const a = 1"),
    _r("agent-no-inline-import", "warn", _H, "agent", ("ImportCall", "Call"), "kind = 'ImportCall' or callee_name = 'require'", "'import inside code'", "Import at the top.", "const a = require('x')", "const a = f('x')"),
    _r("agent-no-default-export", "warn", _H, "agent", ("ExportDefault",), "true", "'default export'", "Named exports keep one name.", "export default f", "export const a = 1"),
    _r("agent-max-file-length", "warn", _H, "agent", (), None, "'file too long'", "Split it by responsibility.", "\n" * 651, "f()"),
    _r("agent-duplicate-cross-file", "info", _H, "agent", (), None, "'same body in another file'", "Move it to a shared module.", "", ""),
    _r("agent-near-duplicate-function", "info", _H, "agent", (), None, "'similar body in another file'", "Merge the two.", "", ""),
    _r("agent-similar-function-name", "info", _H, "agent", (), None, "'same name in another file'", "Reuse or rename.", "", ""),
    _r("agent-similar-shape", "info", _H, "agent", (), None, "'same calls in another file'", "They may do the same.", "", ""),
    _r("oop-singleton-to-layer", "warn", _O, "agent", ("Class",), "exists(members, m -> m.kind = 'Property' and m.static and m.name in ('instance', '_instance', 'instance_', '_self')) and exists(members, m -> m.kind = 'Method' and m.static and m.name in ('getInstance', 'instance', 'get_instance', 'getDefault'))", "'singleton class'", "A layer is built once and can be replaced.", "class A { static instance; static getInstance() { return A.instance } }", "class A { static instance }"),
    _r("oop-observer-to-pubsub", "warn", _O, "agent", ("Class",), f"arrays_overlap({_FIELDS}, array('listeners', '_listeners', 'observers', '_observers', 'subscribers', '_subscribers', 'subscriptions', 'handlers', 'callbacks')) and arrays_overlap({_METHODS}, array('subscribe', 'addListener', 'addObserver', 'attach', 'addEventListener', 'register', 'notify', 'notifyAll', 'emit', 'publish', 'fire', 'broadcast', 'dispatch'))", "'observer class'", "PubSub has backpressure and scopes.", "class A { listeners = []; subscribe(f) {} }", "class A { listeners = [] }"),
    _r("oop-strategy-to-function", "warn", _O, "agent", (), None, "'interface of one method with several implementers'", "A function type is enough.", "interface S { run(): void }\nclass A implements S { run() {} }\nclass B implements S { run() {} }", "interface S { run(): void }\nclass A implements S { run() {} }"),
    _r("oop-visitor-to-match", "warn", _O, "agent", ("Class",), f"size(filter({_METHODS}, m -> m like 'visit_%')) >= 2", "'visitor class'", "Match over a tagged union.", "class A { visitB() {} visitC() {} }", "class A { visitB() {} }"),
    _r("oop-chain-to-catchtag", "warn", _O, "agent", ("Class",), f"arrays_overlap({_FIELDS}, array('next', '_next', 'nextHandler', '_nextHandler', 'successor', 'nextMiddleware')) and arrays_overlap({_METHODS}, array('handle', 'handleRequest', 'setNext', 'setSuccessor', 'setNextHandler'))", "'chain of handlers'", "orElse and catchTag chain effects.", "class A { next; handle(r) {} }", "class A { next }"),
    _r("no-explicit-any", "warn", _T, "on", ("TypeAny",), "true", "'explicit any'", "unknown has to be checked.", "const a: any = 1", "const a: unknown = 1"),
    _r("no-non-null-assertion", "warn", _T, "on", ("NonNull",), "true", "'non-null assertion'", "Handle the missing case.", "const a = b!", "const a = b"),
    _r("no-unsafe-double-cast", "warn", _T, "on", ("As",), "flag", "'double cast'", "Decode with Schema.", "const a = b as unknown as C", "const a = b as C"),
    _r("no-empty-catch", "warn", _T, "on", ("Catch",), "n_stmts = 0", "'empty catch'", "A swallowed error can't be found.", "try { f() } catch (e) {}", "try { f() } catch (e) { g(e) }"),
    _r("no-ts-ignore", "warn", _T, "on", ("Comment",), "contains(str, '@ts-ignore') or contains(str, '@ts-expect-error')", "'type error suppressed'", "Fix the type.", "// @ts-ignore\nf()", "// fine\nf()"),
    _r("max-function-parameters", "warn", _M, "on", ("Function", "Arrow"), "n_params > 4", "concat(n_params, ' parameters')", "Pass an object.", "function f(a, b, c, d, e) {}", "function f(a, b, c, d) {}"),
    _r("max-nesting-depth", "warn", _M, "on", ("Function", "Arrow"), "max_nest > 4", "concat('nested ', max_nest, ' deep')", "Return early or split.", "function f() { if (a) { if (b) { if (c) { if (d) { if (e) { g() } } } } } }", "function f() { if (a) { if (b) { g() } } }"),
    _r("high-cognitive-complexity", "warn", _M, "on", ("Function", "Arrow"), "complexity > 15", "concat('complexity ', complexity)", "Split by decision.", "function f() { if (a) { if (b) { if (c) { if (d) { if (e) { if (h) { g() } } } } } } }", "function f() { if (a) { g() } }"),
    _r("prefer-strict-tsconfig", "warn", _T, "on", (), None, "'strict is off'", "Effect's types rely on strict checking.", "", ""),
    _r("ds-no-banned-import", "warn", "design-system", "config", (), None, "'banned import'", "Use the design system's component.", "", ""),
)

#: (module, property, rule, hint)
RENAMES: tuple[tuple[str, str, str, str], ...] = tuple(
    (module, prop, f"v4-{rule}", hint)
    for rule, rows in {
        "catch-renames": "Effect catchAll Effect.catch|Effect catchAllCause Effect.catchCause|Effect catchAllDefect Effect.catchDefect|Effect catchSome Effect.catchFilter|Effect catchSomeCause Effect.catchCauseFilter|Effect catchSomeDefect gone",
        "fork-renames": "Effect fork Effect.forkChild|Effect forkDaemon Effect.forkDetach|Effect forkAll gone|Effect forkWithErrorHandler gone",
        "context-service": "Effect Tag Context.Service|Effect Service Context.Service|Context Tag Context.Service|Context GenericTag Context.Service",
        "runtime-removed": "Effect runtime Effect.context",
        "scope-provide": "Scope extend Scope.provide",
        "layer-scoped-to-effect": "Layer scoped Layer.effect",
        "option-renames": "Option fromNullable Option.fromNullishOr",
        "cause-flattened": "Cause isFailType Cause.isFailReason|Cause isFailure Cause.hasFails|Cause isDie Cause.hasDies|Cause isInterrupted Cause.hasInterrupts|Cause failureOption Cause.findErrorOption|Cause dieOption Cause.findDefect|Cause sequential Cause.combine|Cause parallel Cause.combine|Cause NoSuchElementException Cause.NoSuchElementError|Cause TimeoutException Cause.TimeoutError|Cause RuntimeException Cause.RuntimeError|Cause IllegalArgumentException Cause.IllegalArgumentError|Cause UnknownException Cause.UnknownError",
        "schema-renames": "Schema TaggedError Schema.TaggedErrorClass|Schema decodeUnknown Schema.decodeUnknownEffect|Schema decode Schema.decodeEffect|Schema decodeUnknownEither Schema.decodeUnknownExit|Schema encodeEither Schema.encodeExit|Schema parseJson Schema.fromJsonString|Schema asSchema Schema.revealCodec|Schema encodedSchema Schema.toEncoded|Schema typeSchema Schema.toType|Schema compose Schema.decodeTo|Schema pick mapFields|Schema omit mapFields|Schema partial mapFields|Schema extend Schema.fieldsAssign|Schema filter Schema.check|Schema transform Schema.decodeTo|Schema transformOrFail Schema.decodeTo|Schema attachPropertySignature Schema.tagDefaultOmit|Schema rename Schema.encodeKeys|Schema keyof gone|Schema validate gone|Schema validateSync gone|Schema withDefaults gone|Schema Data gone|Schema BigIntFromSelf Schema.BigInt|Schema DateFromSelf Schema.Date|Schema OptionFromSelf Schema.Option|Schema EitherFromSelf Schema.Result|Schema Redacted Schema.RedactedFromValue",
    }.items()
    for module, prop, hint in (row.split(" ") for row in rows.split("|"))
)

BY_ID = {r.id: r for r in RULES}
