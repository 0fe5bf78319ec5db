"""Texts with results worked out by hand from the rules, for queries and tests; signals are those under the synthetic pack."""

#: (text, sender, input type, signals in firing order).
SIGNAL_CASES: list[tuple[str, str | None, str, list[str]]] = [
    ("Please share the OTP now", None, "text", ["otp_request"]),
    ("Never share the OTP with anyone", None, "text", ["advisory"]),
    # A code told to the driver in a written message; the same in a call is asked for.
    ("share OTP 4417 with the driver", None, "text", []),
    ("he asked me to share the otp with the driver", None, "call", ["otp_request"]),
    # Asked for after the handover, with no call in between; then with one.
    ("the driver delivered it and said share the otp", None, "call", ["doorstep_code"]),
    ("the driver delivered it, then in a phone he said share the otp", None, "call", ["otp_request"]),
    ("at the door give the code to the driver, share pin", None, "call", ["doorstep_code"]),
    ("share your pin code for the parcel", None, "text", []),
    ("tell me your date of birth", None, "text", ["personal_info_request"]),
    ("Scan the QR code and enter PIN to receive Rs 500", None, "text", ["upi_receive"]),
    ("to receive money you never need to enter your pin", None, "text", []),
    ("approve the request on paytm and return it", None, "text", ["upi_receive"]),
    ("never approve the request to return rs 5", None, "text", []),
    ("see http://1.2.3.4/app.apk", None, "text", ["link_apk", "link_ip", "link_present"]),
    ("see http://sbi-kyc.xyz/a from your bank", None, "text", ["link_suspicious_tld", "link_lookalike", "link_present"]),
    ("see http://update.xyz/a from your bank", None, "text", ["link_suspicious_tld", "link_bank_unofficial", "link_present"]),
    ("see http://update.xyz/a from my bank", None, "text", ["link_suspicious_tld", "link_present"]),
    ("10% discount on bank cards at http://shop.com/x", None, "text", ["link_present"]),
    ("10% discount on your bank cards at http://shop.com/x", None, "text", ["link_bank_unofficial", "link_present"]),
    ("see https://www.sbi.co.in/x or wa.me/919876543210", None, "text", ["official_link", "contact_mobile", "org_contact_mobile"]),
    ("copy the link http://shop.com/x", None, "text", ["link_present", "link_hiding"]),
    ("your bank account", "+91 98765 43210", "text", ["sender_mobile_claims_org"]),
    ("he said my bank is closed", "9876543210", "call", ["call_mobile_claims_org"]),
    ("hello", "AX-SHOPIN-T", "text", ["dlt_sender"]),
    ("hello", "1600123456", "call", ["bank_1600_caller"]),
    ("call 98765 43210 about the flat", None, "text", ["contact_mobile"]),
    # The line to block a card by SMS, beside a toll-free number; from a mobile number it counts.
    ("call 1800 123 4567 or sms block to 9876543210", None, "text", []),
    ("call 1800 123 4567 or sms block to 9876543210", "9123456780", "text", ["contact_mobile"]),
    ("call 9223766666 for the balance", None, "text", []),
    ("rs 50 debited, call 9876543210", None, "text", ["contact_mobile", "fake_alert_callback"]),
    ("customer care 9876543210", None, "text", ["customer_care_bait"]),
    ("urgent work, no hurry", None, "text", ["no_pressure"]),
    ("you are under digital arrest", None, "text", ["digital_arrest"]),
    ("a warrant is out! do not share the otp", None, "text", ["threat_authority", "advisory"]),
    ("parcel seized by the office, drugs found", None, "text", ["courier_seized"]),
    ("the parcel could not be delivered, pay the fee at http://a.com/x", None, "text", ["link_present", "delivery_fee", "advance_fee"]),
    ("you won the lottery", None, "text", ["prize"]),
    ("you won 50 reward points", None, "text", []),
    ("work from home and earn daily", None, "text", ["easy_money"]),
    ("work from home", None, "text", ["easy_money_weak"]),
    ("earn rs 500 per day", None, "text", ["easy_money"]),
    ("200% returns for sure", None, "text", ["investment_promise"]),
    ("join our group", None, "text", ["join_group"]),
    ("no registration fee at all", None, "text", []),
    ("pay rs 500 to receive your gift", None, "text", ["advance_fee"]),
    ("pay the courier charges for your gift", None, "text", ["advance_fee"]),
    ("hiring for a job, you must pay rs 500", None, "text", ["job_fee"]),
    ("a job: pay rs 500 for the form on https://jobs.gov.in/x", None, "text", ["official_link"]),
    ("instant loan", None, "text", ["loan_offer"]),
    ("a flat near you, pay the advance by upi", None, "text", ["unseen_advance"]),
    ("kyc blocked", None, "text", ["kyc_mention"]),
    ("kyc blocked, visit your branch", None, "text", []),
    ("kyc blocked, see https://www.sbi.co.in/x", None, "text", ["official_link", "kyc_mention"]),
    ("kyc blocked, see http://a.com/x", None, "text", ["link_present", "kyc_threat"]),
    ("electricity will be disconnected tonight", None, "text", ["electricity_cut"]),
    ("electricity will be disconnected tonight for maintenance", None, "text", []),
    ("dad had an accident, transfer soon", None, "text", ["relative_emergency"]),
    ("this is my new number", None, "text", ["new_number"]),
    ("upgrade the sim", None, "text", ["sim_swap"]),
    ("click for the refund", None, "text", ["refund_bait"]),
    ("i sent rs 500 by mistake, return it", None, "text", ["wrong_transfer"]),
    ("i got rs 500 by mistake, i will return it", None, "text", []),
    ("pay rs 500 or i leak the video", None, "text", ["sextortion"]),
    ("the yojana: download it", None, "text", ["govt_scheme_bait"]),
    ("free yojana, click the photo", None, "text", ["scheme_click"]),
    ("free, click the photo", None, "text", []),
    ("for the yojana send rs 500 to a1@okbank", None, "text", ["scheme_fee"]),
    ("please donate to a1@okbank", None, "text", ["donation_appeal"]),
    ("challan: http://a.com/x", None, "text", ["link_present", "challan_link"]),
    ("tax refund at http://a.com/x", None, "text", ["link_present", "tax_refund_bait"]),
    ("open anydesk", None, "text", ["remote_access"]),
    ("do not open anydesk", None, "text", []),
    ("dial *401*9876543210", None, "text", ["contact_mobile", "call_forwarding"]),
    ("install it from http://a.com/x", None, "text", ["link_present", "app_install"]),
    ("do not share otp 482913", None, "text", ["genuine_otp_delivery", "advisory"]),
    ("your a/c debited by rs 500", None, "text", ["genuine_txn_alert"]),
    ("come in person to the hall", None, "text", ["in_person"]),
    ("come in person and pay rs 500", None, "text", []),
    ("bring your id card", None, "text", ["in_person"]),
    ("he asked for nothing", None, "call", ["nothing_asked"]),
    ("", None, "text", []),
]

#: (text, folded).
FOLD_CASES: list[tuple[str, str]] = [
    ("0TP bl0cked upd4te XX4421 covid19", "otp blocked update xx4421 covid19"),
    ("hxxps://Site[.]top/x", "https://site.top/x"),
    ("site (dot) in", "site.in"),
    ("go dot com", "go.com"),
    ("dlvry-in . help/pay", "dlvry-in.help/pay"),
    ("done . in the", "done . in the"),
    ("Straße ＡＢ १२३", "strasse ab 123"),
    ("SВI", "sbi"),
    ("क़ानून हँस", "कानून हंस"),
    ("  It’s “so”\t\t now ", "it's \"so\" now"),
    ("", ""),
]

#: (text, sender, language, sender kind, hosts, mobiles, amounts, money at risk).
CONTEXT_CASES: list[tuple] = [
    ("pay ₹1,25,000 now", None, "en", None, [], [], [125000.0], 125000.0),
    ("Rs. 2.5 lakh for you", "", "en", None, [], [], [250000.0], 250000.0),
    ("10 हजार रुपये भेजें", "AX-HDFCBK-T", "hi", "dlt", [], [], [10000.0], 10000.0),
    ("only 499/-", "+91 98765 43210", "en", "mobile", [], [], [499.0], 499.0),
    ("5 crore rupees", "1600123456", "en", "1600", [], [], [5e7], 5e7),
    ("pay 100 or 200 rs", "HDFC Bank", "en", "other", [], [], [200.0], 200.0),
    ("call +91 98765 43210", None, "en", None, [], ["9876543210"], [], 0.0),
    ("call 09876543210", None, "en", None, [], ["9876543210"], [], 0.0),
    ("1234567890 and 19876543210", None, "en", None, [], [], [], 0.0),
    ("98765-43210 and 9876543210", None, "en", None, [], ["9876543210"], [], 0.0),
    ("https://www.Example.com:8080/a, and example.com/b", None, "en", None, ["example.com"], [], [], 0.0),
    ("10.0.0.1/x and 10.0.0.2", None, "en", None, ["10.0.0.1"], [], [], 0.0),
    ("see a.b-c.co.in/x?y=1).", None, "en", None, ["a.b-c.co.in"], [], [], 0.0),
    ("wa.me/919876543210", None, "en", None, ["wa.me"], ["9876543210"], [], 0.0),
    ("aap ka paisa", None, "hinglish", None, [], [], [], 0.0),
    # The prize is bait, the fee is asked for; a fee as near as the bait wins; without any cue the largest counts.
    ("you won rs 5000. pay rs 99 as fee", None, "en", None, [], [], [5000.0, 99.0], 99.0),
    ("fee rs 70 loan", None, "en", None, [], [], [70.0], 70.0),
    ("a prize of rs 800", None, "en", None, [], [], [800.0], 0.0),
    ("rs 10 and rs 30", None, "en", None, [], [], [10.0, 30.0], 30.0),
    ("😀 rs 7", None, "en", None, [], [], [7.0], 7.0),
    ("", None, "en", None, [], [], [], 0.0),
]

#: (payload, kind, amount as told, flags, number of facts, text to check).
PAYLOAD_CASES: list[tuple] = [
    ("upi://pay?pa=a1@ybl&pn=Offers&am=4999&tn=Cashback", "upi", "₹4,999", ["receive_claim"], 1, "Scan the QR and enter your UPI PIN to receive money. Cashback Offers"),
    ("upi://pay?pa=k1@okbank&pn=SBI%20KYC&am=10&tn=Update", "upi", "₹10", ["official_name"], 2, "Pay ₹10 to SBI KYC (k1@okbank). Update"),
    ("upi://pay?pa=k1@okbank&pn=SBI%20KYC&am=10&mc=0000", "upi", "₹10", [], 1, "Pay ₹10 to SBI KYC (k1@okbank)."),
    ("upi://pay?pa=shop@upi&pn=Corner+Shop&am=250", "upi", "₹250", [], 1, "Pay ₹250 to Corner Shop (shop@upi)."),
    ("UPI://pay?PA=shop@upi&am=12500.5", "upi", "₹12,500.50", ["large_amount"], 1, "Pay ₹12,500.50 to  (shop@upi)."),
    ("upi://pay?pa=x@y&am=0", "upi", None, [], 1, "Pay money to  (x@y)."),
    ("upi://pay?pa=x@y&am=abc&tn=gift", "upi", None, ["receive_claim"], 1, "Scan the QR and enter your UPI PIN to receive money. gift"),
    ("https://a.com/x", "link", None, [], 0, "https://a.com/x"),
    ("WWW.a.com", "link", None, [], 0, "WWW.a.com"),
    (" upi://pay?pa=x@y", "text", None, [], 0, " upi://pay?pa=x@y"),
    ("hello", "text", None, [], 0, "hello"),
]
