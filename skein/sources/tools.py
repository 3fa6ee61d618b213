"""Formats that need a program of the machine: PDF and the old binary office files. Without it, a warning and no text."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
import threading

from skein.settings import Settings

TIMEOUT, STDERR_BYTES, LEAVE = 60, 65_536, 5
#: Stream names of old office files, in the order in which they decide, with the program that reads each.
LEGACY = (
    (("WordDocument",), "catdoc", ("-d", "utf-8", "-w"), "Word 97-2003 document"),
    (("PowerPoint Document",), "catppt", ("-d", "utf-8"), "PowerPoint 97-2003 presentation"),
    (("Workbook", "Book"), "xls2csv", ("-d", "utf-8"), "Excel 97-2003 workbook"),
)


def run_tool(command: list[str], raw: bytes, limit: int, timeout: float = TIMEOUT) -> tuple[str, str]:
    """(output, warning) of a program that gets the bytes as a file in place of ``{}``.

    No shell. Both outputs are drained at once; reading stops at the limit; a program that runs too long is
    asked to end, then killed.
    """
    with tempfile.NamedTemporaryFile() as f:
        f.write(raw)
        f.flush()
        process = subprocess.Popen([f.name if a == "{}" else a for a in command], stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
        errors: list[bytes] = []
        chunks: list[bytes] = []

        def drain(stream, into: list[bytes], most: int, stop: bool) -> None:
            size = 0
            while data := stream.read1(65_536):
                if size < most:
                    into.append(data[: most - size])
                size += len(data)
                if stop and size >= most:
                    process.terminate()
                    return

        threads = [threading.Thread(target=drain, args=(process.stderr, errors, STDERR_BYTES, False), daemon=True), threading.Thread(target=drain, args=(process.stdout, chunks, limit, True), daemon=True)]
        for t in threads:
            t.start()
        warning = ""
        try:
            process.wait(timeout)
        except subprocess.TimeoutExpired:
            warning = f"{os.path.basename(command[0])} took longer than {timeout:g} s"
            process.terminate()
            try:
                process.wait(LEAVE)
            except subprocess.TimeoutExpired:
                process.kill()
                process.wait()
        for t in threads:
            t.join(LEAVE)
        text = b"".join(chunks).decode("utf-8", "replace")
        if not warning and process.returncode > 0 and not text:
            warning = f"{os.path.basename(command[0])} failed: " + b"".join(errors).decode("utf-8", "replace").strip()[:200]
        return text, warning


def pdf(raw: bytes, settings: Settings) -> tuple[str, str]:
    tool = settings.pdftotext_path or shutil.which("pdftotext")
    if settings.pdf_extractor == "pdfparser" or not tool:
        return "", "no PDF reader is available here, indexed without content"
    return run_tool([tool, "-q", "-enc", "UTF-8", "{}", "-"], raw, 2 * settings.max_content_size + 1)


def legacy_office(raw: bytes, settings: Settings) -> tuple[str, str]:
    if "EncryptedPackage".encode("utf-16-le") in raw:
        return "", "password-protected office file, indexed without content"
    for streams, tool, arguments, label in LEGACY:
        if any(s.encode("utf-16-le") + b"\0\0" in raw for s in streams):
            path = shutil.which(tool)
            if not path:
                return "", f"{label}: {tool} is not installed, indexed without content"
            return run_tool([path, *arguments, "{}"], raw, 2 * settings.max_content_size + 1)
    return "", "compound file in an unsupported format, indexed without content"
