"""quirel.plans"""
