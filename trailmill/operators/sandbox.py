"""Running tests of generated code in a process of its own.

The worker process is the same for every job; code and tests reach it as data. Each passed test is reported through a
pipe of its own together with a mark drawn for the run, and the end of all tests likewise, so neither what the code
prints nor how it exits can raise the count, which is bounded by the number of tests. The mark is in the memory of the
process that runs the code: this keeps out code that prints or exits, not an attacker who searches the interpreter.

Defined cases: without tests, on a crash, an exit before the last test, a timeout, code that does not compile, or any
output but white space the result is 0. Tests run in order in one name space; a failed one does not stop the others.
"""

from __future__ import annotations

import json
import os
import secrets
import selectors
import signal
import subprocess
import sys
import time

#: Seconds for each test, and at least.
PER_TEST_S, LEAST_S = 2, 5
CPU_S, MEMORY = 30, 1 << 30

_WORKER = """
import json, os, sys

def work(pipe):
    job = json.loads(sys.stdin.buffer.read())
    mark, names = job.pop("mark"), {"__name__": "__main__"}
    tell = lambda what: os.write(pipe, (mark + " " + what + chr(10)).encode())
    for source in (*job["imports"], job["code"]):
        exec(compile(source, "code", "exec"), names)
    for number, source in enumerate(job["tests"]):
        try:
            exec(compile(source, "test", "exec"), names)
        except Exception:
            continue
        tell(str(number))
    sys.stdout.flush()
    tell("end")

work(int(sys.argv[1]))
"""


def _limits() -> None:
    import resource

    resource.setrlimit(resource.RLIMIT_CPU, (CPU_S, CPU_S))
    resource.setrlimit(resource.RLIMIT_AS, (MEMORY, MEMORY))
    resource.setrlimit(resource.RLIMIT_FSIZE, (0, 0))


def _listen(child: subprocess.Popen, reports: int, most: int, deadline: float) -> bytes | None:
    """What comes through the pipe until both ends are closed; null if the code prints, reports too much or is late."""
    heard = b""
    with selectors.DefaultSelector() as ready:
        ready.register(child.stdout, selectors.EVENT_READ)
        ready.register(reports, selectors.EVENT_READ)
        while ready.get_map():
            left = deadline - time.monotonic()
            if left <= 0:
                return None
            for key, _ in ready.select(left):
                data = os.read(key.fd, 1 << 16)
                if not data:
                    ready.unregister(key.fileobj)
                elif key.fd == reports:
                    heard += data
                    if len(heard) > most:
                        return None
                elif data.strip():
                    return None
    return heard


def run_tests(code: str, imports: list[str], tests: list[str]) -> int:
    """How many of the tests pass."""
    if not tests:
        return 0
    mark = secrets.token_hex(16)
    job = json.dumps({"mark": mark, "imports": imports, "code": code, "tests": tests}).encode()
    deadline = time.monotonic() + max(LEAST_S, PER_TEST_S * len(tests))
    reports, far = os.pipe()
    child = None
    try:
        child = subprocess.Popen(
            [sys.executable, "-I", "-c", _WORKER, str(far)], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL,
            pass_fds=(far,), start_new_session=True, preexec_fn=_limits, env={},
        )
        os.close(far)
        far = -1
        child.stdin.write(job)
        child.stdin.close()
        heard = _listen(child, reports, (len(mark) + 24) * (len(tests) + 1), deadline)
        if heard is None or child.wait(max(0.1, deadline - time.monotonic())) != 0:
            return 0
    except (OSError, ValueError, subprocess.TimeoutExpired):
        return 0
    finally:
        os.close(reports)
        if far >= 0:
            os.close(far)
        if child is not None:
            try:
                os.killpg(child.pid, signal.SIGKILL)
            except ProcessLookupError:
                pass
            child.stdout.close()
            child.wait()
    said = {line[len(mark) + 1 :] for line in heard.decode(errors="replace").splitlines() if line.startswith(f"{mark} ")}
    return sum(str(i) in said for i in range(len(tests))) if "end" in said else 0
