"""A paged service in memory, a model and an HTTP server for tests."""

import functools
import http.server
import json
import os
import threading
import urllib.parse

ROWS = {"empty": 0, "one": 3, "rest": 7, "exact": 6, "huge": 10_000}


def page(rows, offset, step):
    return 200, json.dumps({"paging": {"index": offset, "matches": len(rows)}, "values": rows[offset : offset + step]})


@functools.cache
def transactions(account):
    return [
        {"reference": f"{account}-{k}", "bookingStatus": "BOOKED" if k % 2 == 0 else "NOTBOOKED", "bookingDate": "2025-03-01", "amount": {"value": str(k), "unit": "EUR"}, "valutaDate": "2025-03-01", "newTransaction": False, "remittanceInfo": "x", "transactionType": {"key": "K", "text": "T"}}
        for k in range(ROWS[account])
    ]


def balance(account, value):
    return {"account": {"iban": f"i-{account}", "bic": "b", "accountId": account, "accountDisplayId": f"d-{value}", "accountType": {"text": "t"}}, "accountId": account, "balance": {"value": value, "unit": "EUR"}}


BALANCES = [balance("one", "1.5"), balance("rest", "2"), balance("one", "9"), balance("exact", "bad"), balance("empty", "0")]


class Bank:
    def __init__(self, step: int, log: str = ""):
        self.step, self.log = step, log

    def get(self, path, query):
        offset = int(query["paging-first"])
        if self.log:
            with open(os.path.join(self.log, f"{os.getpid()}-{threading.get_ident()}"), "a") as f:
                f.write(f"{path} {offset}\n")
        if path.endswith("balances"):
            return page(BALANCES, offset, self.step)
        assert query["transactionState"]
        return page(transactions(path.split("/")[-2]), offset, self.step)


def bank(options):
    return Bank(int(options.get("step", 3)), options.get("log", ""))


class Growing:
    """Documents of a file that a test lengthens."""

    def __init__(self, path: str):
        self.path = path

    def get(self, path, query):
        with open(self.path) as f:
            return page([x for x in json.load(f) if x["account"] == path.split("/")[-2]], int(query["paging-first"]), 2)


def growing(options):
    return Growing(options["path"])


class Moods:
    """Answers what the list says, one after the other."""

    def __init__(self, answers):
        self.answers = list(answers)

    def get(self, path, query):
        found = self.answers.pop(0)
        if isinstance(found, Exception):
            raise found
        return found


def failing(options):
    bad = Bank(2)

    class Failing:
        def get(self, path, query):
            return (int(options["status"]), "no") if path.endswith("transactions") and query["paging-first"] == "4" else bad.get(path, query)

    return Failing()


class Model:
    def __init__(self, options):
        self.left = {"4": 2}

    def answer(self, question):
        good = {"reference": "any", "category": "food", "subcategory": "bread", "confidence": 0.5, "reasoning": "r"}
        if self.left.get(question, 0):
            self.left[question] -= 1
            raise OSError("busy")
        if question == "5":
            raise ConnectionError("gone")
        odd = {"1": "no json", "2": {**good, "confidence": 1.5}, "3": {**good, "category": "unknown"}, "6": {k: v for k, v in good.items() if k != "reasoning"}, "7": [good], "8": {**good, "confidence": "much"}}.get(question, good)
        return odd if isinstance(odd, str) else json.dumps(odd)


class _Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        at = urllib.parse.urlsplit(self.path)
        self.server.seen.append({k.lower(): v for k, v in self.headers.items()})
        status, body = (401, "") if self.headers["Authorization"] != "Bearer secret" else Bank(2).get(at.path.strip("/"), {"transactionState": "BOOKED", **dict(urllib.parse.parse_qsl(at.query))})
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


def serve():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Handler)
    server.seen = []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
