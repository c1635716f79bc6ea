from __future__ import annotations

import re

from findlake.operators import routes


def test_every_sign_holds_a_word_that_is_looked_for_first():
    signs = ["LOGIN_required", "require_auth", "requireUser", "authenticated", "Authorization", "bearer", "JWT", "jsonwebtoken", "passport", "apiKey", "api_key", "x-api-key", "current_user", "currentUser", "@PreAuthorize", "@Secured", "@RolesAllowed", "SecurityFilterChain", "basic_auth", "verify_password", "check_password", "password_hash", "bcrypt", "hmac", "session[0", "OAuth", "is_authenticated", "get_current_user", "HTTPBearer"]
    assert all(re.search(routes.AUTH, s) and any(w in s.lower() for w in routes.AUTH_WORDS) for s in signs)
    mails = ["smtplib", '"net/smtp"', "nodemailer", "jakarta.mail", "javax.mail", "Net::SMTP", "ActionMailer", "delivery_method", "Mail.new", "smtp.SendMail", "sendgrid", "mailgun"]
    assert all(re.search(routes.MAIL, s) and any(w in s.lower() for w in routes.MAIL_WORDS) for s in mails)


def test_routes_are_looked_for_once(spark):
    files = spark.createDataFrame([("r", "a", "go", 'x\nm.HandleFunc("DELETE /a", f) // authed'), ("r", "b", "go", 'm.HandleFunc("DELETE /a", requireUser)\nm.HandleFunc("DELETE /b", f)')], "repo_id string, path string, language string, content string")
    found = routes.open_routes(files)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # one for the repositories, one for the routes
    assert [(r.path, r.line_no, r.issue) for r in found.collect()] == [("b", 2, "destructive")]
