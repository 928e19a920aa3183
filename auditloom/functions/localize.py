"""Findings' texts in Chinese: whole texts, then names in snake case, then tokens in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .severity import _mapped
from .text import text_or_empty

#: Whole texts.
EXACT = {
    "Injection": "注入类漏洞", "SQL Injection": "SQL 注入", "Log Injection": "日志注入", "HTTP Parameter Injection": "HTTP 参数注入", "LDAP Injection": "LDAP 注入", "Command Injection": "命令注入",
    "Template Injection": "模板注入", "CSRF": "跨站请求伪造", "Timing Attack": "时序侧信道", "Hardcoded Credentials": "硬编码凭据", "Weak Password Hashing": "弱密码哈希",
    "Weak Cryptography": "弱密码学配置", "Information Disclosure": "信息泄露", "CORS Misconfiguration": "CORS 配置不当", "Security Misconfiguration": "安全配置不当", "Stored XSS": "存储型 XSS",
    "Reflected XSS": "反射型 XSS", "DOM-based XSS": "DOM 型 XSS", "Missing Authentication": "缺少身份认证", "Broken Access Control": "访问控制缺陷", "Path Traversal": "路径遍历",
    "Directory Traversal": "目录遍历", "Remote Code Execution": "远程代码执行", "RCE": "远程代码执行", "SSRF": "服务端请求伪造", "IDOR": "对象级越权", "Privilege Escalation": "权限提升",
    "Authentication Bypass": "认证绕过", "Authorization Bypass": "授权绕过",
}
#: Names in snake case.
SNAKE = {
    "arbitrary_file_read": "任意文件读取", "arbitrary_file_write": "任意文件写入", "broken_access_control": "访问控制缺陷", "command_execution": "命令执行", "command_injection": "命令注入",
    "config_leak": "配置泄露", "denial_of_service": "拒绝服务", "hardcoded_secret": "硬编码密钥", "idor": "对象级越权", "path_traversal": "路径遍历", "privilege_escalation": "权限提升",
    "sql_injection": "SQL 注入", "stored_xss": "存储型 XSS", "weak_password_hash": "弱密码哈希",
}
#: Tokens, replaced in this order wherever they stand.
TOKENS = (
    ("SQL Injection", "SQL 注入"), ("Log Injection", "日志注入"), ("HTTP Parameter Injection", "HTTP 参数注入"), ("Hardcoded Credentials", "硬编码凭据"), ("Weak Password Hashing", "弱密码哈希"),
    ("Weak Cryptography", "弱密码学配置"), ("Information Disclosure", "信息泄露"), ("CORS Misconfiguration", "CORS 配置不当"), ("Security Misconfiguration", "安全配置不当"), ("Stored XSS", "存储型 XSS"),
    ("Reflected XSS", "反射型 XSS"), ("DOM-based XSS", "DOM 型 XSS"), ("Missing Authentication", "缺少身份认证"), ("Broken Access Control", "访问控制缺陷"), ("Path Traversal", "路径遍历"),
    ("Directory Traversal", "目录遍历"), ("Command Injection", "命令注入"), ("Remote Code Execution", "远程代码执行"), ("LDAP Injection Potential", "LDAP 注入风险"), ("LDAP Injection", "LDAP 注入"),
    ("Injection", "注入类漏洞"), ("CSRF", "跨站请求伪造"), ("Timing Attack", "时序侧信道"), ("Limited Impact", "影响受限"), ("Non-Browser Context", "非浏览器上下文"),
    ("Dependent on Frontend Rendering", "依赖前端渲染"), ("Indirect", "间接触发"), ("via", "来源"), ("SSRF", "服务端请求伪造"), ("IDOR", "对象级越权"), ("Privilege Escalation", "权限提升"),
    ("Authentication Bypass", "认证绕过"), ("Authorization Bypass", "授权绕过"),
)


def localize(c: Column | str) -> Column:
    t = F.trim(text_or_empty(c))
    return F.coalesce(_mapped(t, EXACT), _mapped(F.lower(t), SNAKE), reduce(lambda out, kv: F.replace(out, F.lit(kv[0]), F.lit(kv[1])), TOKENS, t))
